"""Queries that state in SQL what files, reasons, geometry and fitted models must satisfy."""

from pyspark.sql import functions as F

from gridtide import texts
from gridtide.functions.columns import file_date, is_daily_file
from gridtide.functions.sizes import cut_lineage
from gridtide.operators import features, models
from gridtide.plans.alert_queries import SCORED_SQL, zone_alerts
from gridtide.plans.binding import WIDTH, with_hourly
from gridtide.plans.catalog import query
from gridtide.plans.feature_queries import DROP_ROWS_SQL, ZONE_ROWS_SQL, drop_rows
from gridtide.schemas import DROP_FEATURES, FORECAST_FEATURES, RAW_COLUMNS
from gridtide.sources.geojson import centroids, grid_reference
from gridtide.streaming.intake import file_verdicts, placed

_NAMES = ("sms-call-internet-mi-{}.csv", "sms-call-internet-mi-{}.csv.bak", "old-sms-call-internet-mi-{}.csv", "sms-call-internet-mi.csv")


@query(
    "WITH days AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS d FROM events), names AS ("
    + " UNION ALL ".join("SELECT " + "'" + name.replace("{}", "' || d || '") + "' AS file_name FROM days" for name in _NAMES)
    + ") SELECT file_name, count(*) AS files, regexp_full_match(file_name, 'sms-call-internet-mi-[0-9]{4}-[0-9]{2}-[0-9]{2}[.]csv') "
    "AS is_daily, CAST(nullif(regexp_extract(file_name, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), '') AS DATE) AS file_date FROM names GROUP BY file_name"
)
def daily_file_names(t):
    """Which names of files are daily files, and the date in them."""
    days = t.read("events").select(F.date_format("ts", "yyyy-MM-dd").alias("d")).distinct()
    names = F.array(*[F.replace(F.lit(name), F.lit("{}"), F.col("d")) for name in _NAMES])
    counted = days.select(F.explode(names).alias("file_name")).groupBy("file_name").agg(F.count(F.lit(1)).alias("files"))
    return counted.select("file_name", "files", is_daily_file("file_name").alias("is_daily"), file_date("file_name").alias("file_date"))


_HEADER = ",".join(RAW_COLUMNS)
_SWAPPED = _HEADER.replace("smsin,smsout", "smsout,smsin")
_MISMATCH = texts.SCHEMA_MISMATCH.format(expected="[" + ", ".join(f"''{name}''" for name in RAW_COLUMNS) + "]") + (
    "[" + ", ".join(f"''{name}''" for name in _SWAPPED.split(",")) + "]"
)


@query(
    "WITH lines AS (SELECT user_id % 4 AS kind, user_id AS source, value FROM events), files AS (SELECT source, any_value(kind) AS kind, "
    "count(*) AS n, count(*) FILTER (WHERE value < 20) AS bad FROM lines GROUP BY 1) SELECT CAST(source AS VARCHAR) AS source, CASE WHEN "
    "kind IN (1, 2) OR (kind = 3 AND bad > 0) THEN 'REJECTED' ELSE 'VALID' END AS status, CASE WHEN kind IN (1, 2) THEN 0 ELSE n END AS "
    f"row_count, CASE WHEN kind = 1 THEN '{_MISMATCH}' WHEN kind = 2 THEN '{texts.RAGGED}' || n WHEN kind = 3 AND bad > 0 THEN "
    f"'{texts.BAD_TIME}' || bad ELSE '{texts.CHECKS_PASSED}' END AS reason FROM files"
)
def file_header_verdicts(t):
    """Verdict per file of text lines: users are files with a right header, swapped columns, too many cells or bad times."""
    events = t.read("events")
    kind = F.col("user_id") % 4
    time = F.when((kind == 3) & (F.col("value") < 20), "never").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    cells = [time, F.lit("7"), F.lit("39"), F.format_string("%.2f", F.abs("value")), F.lit(""), F.lit(""), F.lit(""), F.lit("1.5")]
    line = F.concat(F.concat_ws(",", *cells), F.when(kind == 2, ",9").otherwise(""))
    body = events.select(line.alias("value"), F.col("user_id").cast("string").alias("source"), F.lit(1).cast("long").alias("block"))
    header = F.when(kind == 1, _SWAPPED).otherwise(_HEADER)
    heads = events.select("user_id").distinct().select(header.alias("value"), F.col("user_id").cast("string").alias("source"), F.lit(0).cast("long").alias("block"))
    return file_verdicts(placed(heads.unionByName(body)))


def _reason_sql(kind, flag, reference, against, multiplier):
    ratio = f"CASE WHEN {reference} = 0 THEN CASE WHEN total_activity > 0 THEN 'inf' ELSE 'nan' END ELSE printf('%.2f', total_activity / {reference}) END"
    return (
        f"SELECT grid_id, timestamp, '{kind}' AS alert_type, '{texts.ALERT_START}' || printf('%.2f', total_activity) || ' is ' || {ratio} || "
        f"'x {against} of ' || printf('%.2f', {reference}) || ' (threshold {multiplier}x)' AS reason FROM flagged WHERE {flag}"
    )


_BASELINE, _PREVIOUS = (text.replace("'", "''") for text in (texts.AGAINST_BASELINE, texts.AGAINST_PREVIOUS))


@query(
    f"{with_hourly('zone')}, {SCORED_SQL} "
    + _reason_sql("HIGH_ACTIVITY", "high_activity_flag", "baseline_activity", _BASELINE, "2.0")
    + " UNION ALL "
    + _reason_sql("ACTIVITY_DROP", "drop_flag", "baseline_activity", _BASELINE, "0.5")
    + " UNION ALL "
    + _reason_sql("ACTIVITY_SPIKE", "spike_flag", "previous", _PREVIOUS, "3.0")
)
def alert_reasons(t):
    """The sentence of every alert."""
    return zone_alerts(t).select("grid_id", "timestamp", "alert_type", "reason")


def _features(t):
    """Customers as GeoJSON features: a square each, one in seven without an id and one in five a point."""
    key = F.col("c_custkey")
    x, y = key % WIDTH, F.floor(key / WIDTH)
    corner = [F.format_string("[%d,%d]", (x + dx).cast("long"), (y + dy).cast("long")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
    point = key % 5 == 0
    square = F.concat(F.lit("[["), F.concat_ws(",", *corner), F.lit("]]"))
    return t.read("customer").select(
        F.lit("FeatureCollection").alias("collection_type"),
        F.lit("Feature").alias("type"),
        F.lit(None).cast("string").alias("id"),
        F.struct(F.when(key % 7 != 0, key.cast("string")).alias("cellId"), F.lit(None).cast("string").alias("cell_id"), F.lit(None).cast("string").alias("id")).alias("properties"),
        F.struct(F.when(point, "Point").otherwise("Polygon").alias("type"), F.when(point, corner[0]).otherwise(square).alias("coordinates")).alias("geometry"),
    )


_SHAPES_SQL = (
    f"WITH c AS (SELECT c_custkey AS k, c_custkey % {WIDTH} AS x, c_custkey // {WIDTH} AS y FROM customer WHERE c_custkey % 7 <> 0)"
)


@query(f"{_SHAPES_SQL} SELECT k + 1 AS grid_id, (5 * y + 2) / 5.0::DOUBLE AS centroid_latitude, (5 * x + 2) / 5.0::DOUBLE AS centroid_longitude FROM c WHERE k % 5 <> 0")
def feature_centroids(t):
    return centroids(_features(t), id_offset=1)


@query(
    f"{_SHAPES_SQL} SELECT k AS grid_id, CASE WHEN k % 5 = 0 THEN printf('{{\"type\":\"Point\",\"coordinates\":[%d,%d]}}', x, y) ELSE "
    "printf('{\"type\":\"Polygon\",\"coordinates\":[[[%d,%d],[%d,%d],[%d,%d],[%d,%d],[%d,%d]]]}', x, y, x + 1, y, x + 1, y + 1, x, y + 1, x, y) "
    "END AS geometry FROM c"
)
def feature_geometry(t):
    return grid_reference(_features(t))


@query(f"{with_hourly()} SELECT count(DISTINCT grid_id) AS cells, 0 AS outside FROM hourly")
def cluster_check(t):
    """Every cell has one label, and no label lies outside 0..k-1."""
    labels = models.cluster_cells(t.hourly())
    inside = F.col("cell_cluster").between(0, models.CLUSTERS - 1)
    return labels.agg(F.countDistinct("grid_id").alias("cells"), F.count_if(~inside).cast("int").alias("outside"))


_SPLIT_SQL = (
    ", per_hour AS (SELECT timestamp, count(*) AS n FROM rows GROUP BY 1), ahead AS (SELECT timestamp, coalesce(sum(n) OVER (ORDER BY "
    "timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM per_hour), cut AS (SELECT "
    "min(timestamp) AS c FROM ahead WHERE before >= total * 0.8)"
)


@query(
    f"{DROP_ROWS_SQL}{_SPLIT_SQL} SELECT count(*) AS rows_scored, true AS chances_valid, {len(DROP_FEATURES)} AS features, true AS "
    "importances_sum_to_one FROM rows, cut WHERE timestamp >= c"
)
def drop_model_check(t):
    """The boosted detector gives every test row a chance and weighs all features."""
    train, test = features.chronological_split(cut_lineage(drop_rows(t)))
    model = models.train_drop_classifier(train)
    scored = models.drop_scores(model, test)
    weights = models.feature_importance(t.spark, model, DROP_FEATURES)
    weight = weights.agg(F.struct(F.count("importance").cast("int").alias("n"), F.sum("importance").alias("total")).alias("w")).scalar()
    counted = scored.agg(F.count(F.lit(1)).alias("rows_scored"), F.bool_and(F.col("drop_probability").between(0, 1)).alias("chances_valid"))
    return counted.withColumn("w", weight).select(
        "rows_scored", "chances_valid", F.col("w.n").alias("features"), (F.abs(F.col("w.total") - 1) < 1e-9).alias("importances_sum_to_one")
    )


@query(
    f"{ZONE_ROWS_SQL}, target_days AS (SELECT target_date, row_number() OVER (ORDER BY target_date) AS i, count(*) OVER () AS n FROM (SELECT "
    "DISTINCT target_date FROM rows)) SELECT count(*) AS rows_forecast, true AS never_negative, true AS beats_mean FROM rows JOIN target_days "
    "USING (target_date) WHERE i > n - greatest(1, round_even(n * 0.2, 0))"
)
def forecast_check(t):
    """The forecast covers every test row, is never negative and has a smaller error than the training mean."""
    rows = cut_lineage(features.forecast_training_rows(features.forecast_features(t.hourly("zone"), width=WIDTH)))
    train, validation, test = features.split_by_target_date(rows, *features.date_parts(rows))
    model = models.train_forecaster(train, validation, FORECAST_FEATURES)
    mean = train.agg(F.avg("internet_target")).first()[0]
    error, plain = F.abs(F.col("internet_target") - F.col("y_pred")), F.abs(F.col("internet_target") - F.lit(mean))
    return models.forecast(model, test).agg(
        F.count(F.lit(1)).alias("rows_forecast"), F.bool_and(F.col("y_pred") >= 0).alias("never_negative"), (F.avg(error) < F.avg(plain)).alias("beats_mean")
    )
