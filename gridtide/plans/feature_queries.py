"""Queries over features, neighbourhoods and residual scores."""

from pyspark.sql import functions as F

from gridtide.functions.ranks import exact_median, exact_percentile
from gridtide.functions.sizes import cut_lineage, scratch_path
from gridtide.operators import features, spatial
from gridtide.plans.binding import WIDTH, rounded, with_hourly, with_shipments_hourly
from gridtide.plans.catalog import query
from gridtide.streaming.series import apply_batch, current_features

_HOURLY = with_hourly()
_ZONES = with_hourly("zone")
_SERIES = "PARTITION BY grid_id ORDER BY timestamp"


def _neighbors_sql(value, out):
    """Mean of the lattice neighbours by a self-join on time and lattice distance."""
    return (
        f"placed AS (SELECT grid_id, timestamp, {value} AS v, (grid_id - 1) % {WIDTH} AS x, (grid_id - 1) // {WIDTH} AS y "
        "FROM hourly), neighbors AS (SELECT a.grid_id, a.timestamp, "
        f"avg(b.v) AS {out} FROM placed a LEFT JOIN placed b ON a.timestamp = b.timestamp AND abs(a.x - b.x) <= 1 AND "
        "abs(a.y - b.y) <= 1 AND a.grid_id <> b.grid_id GROUP BY 1, 2)"
    )


_TRAILING = (
    "past_day AS (SELECT grid_id, timestamp, hour, internet_activity, call_in, call_out, total_activity, "
    "avg(total_activity) OVER day AS avg_activity, CASE WHEN lag(timestamp) OVER s IS NOT NULL THEN count(*) FILTER "
    "(WHERE total_activity > 0) OVER day END AS active_hours, max(total_activity) OVER day / nullif(avg(total_activity) "
    "OVER day, 0) AS peak_ratio, stddev_samp(total_activity) OVER day / nullif(avg(total_activity) OVER day, 0) AS "
    "variability, avg(total_activity) OVER recent / nullif(avg(total_activity) OVER earlier, 0) AS activity_growth, "
    "lag(coalesce(internet_activity / nullif(total_activity, 0), 0)) OVER s AS internet_share_at_t, "
    "lag(total_activity, 24) OVER s AS activity_lag_24, lead(total_activity) OVER s AS next_activity FROM hourly WINDOW "
    f"s AS ({_SERIES}), day AS ({_SERIES} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), recent AS ({_SERIES} ROWS BETWEEN "
    f"12 PRECEDING AND 1 PRECEDING), earlier AS ({_SERIES} ROWS BETWEEN 24 PRECEDING AND 13 PRECEDING))"
)
_RATIOS = ("avg_activity", "peak_ratio", "variability", "activity_growth", "internet_share_at_t")


_TRAILING_SQL = (
    f"{_HOURLY}, {_TRAILING} SELECT grid_id, timestamp, active_hours, "
    + ", ".join(f"ROUND({name}, 6) AS {name}" for name in (*_RATIOS, "activity_lag_24", "next_activity"))
    + " FROM past_day"
)


def _trailing(table):
    return rounded(
        table.select("grid_id", "timestamp", "active_hours", "activity_lag_24", "next_activity", *_RATIOS), 6
    )


@query(_TRAILING_SQL)
def trailing_features(t):
    return _trailing(features.trailing_features(t.hourly()))


@query(_TRAILING_SQL)
def trailing_features_by_batch(t):
    """The same features, kept current over four batches of a third of a month each, a tenth of the rows a batch late."""
    out, table = scratch_path(t.spark), cut_lineage(t.hourly())
    late = F.pmod(F.xxhash64("grid_id", "timestamp"), F.lit(10)) == 0
    arrival = F.least(F.floor((F.dayofmonth("timestamp") - 1) / 11), F.lit(2)) + late.cast("int")
    for number in range(4):
        apply_batch(table.where(arrival == number), number, out)
    return _trailing(current_features(t.spark, out))


_DROP = (
    f"{_TRAILING}, {_neighbors_sql('total_activity', 'neighbor_avg_activity')}, drop_features AS (SELECT t.*, "
    "sin(2 * pi() * hour / 24.0) AS hour_sin, cos(2 * pi() * hour / 24.0) AS hour_cos, CASE WHEN call_in + call_out > 0 "
    "THEN internet_activity / (call_in + call_out) ELSE 0 END AS data_to_voice_ratio, CAST(isodow(timestamp) - 1 AS "
    f"INTEGER) AS day_of_week, CAST((grid_id - 1) % {WIDTH} AS INTEGER) AS x, CAST((grid_id - 1) // {WIDTH} AS INTEGER) "
    "AS y, neighbor_avg_activity, CAST(coalesce(next_activity < 0.4::DOUBLE * avg_activity, false) AS INTEGER) AS "
    "target_drop FROM past_day t JOIN neighbors USING (grid_id, timestamp))"
)
_DROP_DOUBLES = (*_RATIOS, "hour_sin", "hour_cos", "data_to_voice_ratio", "activity_lag_24", "neighbor_avg_activity")
_DROP_SELECT = (
    "SELECT grid_id, timestamp, hour, day_of_week, x, y, active_hours, target_drop, "
    + ", ".join(f"ROUND({name}, 6) AS {name}" for name in _DROP_DOUBLES)
    + " FROM drop_features"
)


@query(f"{_HOURLY}, {_DROP} {_DROP_SELECT}")
def drop_features(t):
    return rounded(features.drop_features(t.hourly(), WIDTH), 6)


DROP_ROWS_SQL = f"{_HOURLY}, {_DROP}, rows AS ({_DROP_SELECT} WHERE " + " AND ".join(
    f"{name} IS NOT NULL" for name in (*_DROP_DOUBLES, "active_hours")
) + ")"


def drop_rows(t):
    """Complete training rows, rounded so that statistics over them are comparable."""
    return rounded(features.drop_training_rows(features.drop_features(t.hourly(), WIDTH)), 6)


@query(f"{DROP_ROWS_SQL} SELECT * FROM rows")
def drop_training_rows(t):
    return drop_rows(t)


@query(
    f"{DROP_ROWS_SQL}, per_hour AS (SELECT timestamp, count(*) AS n FROM rows GROUP BY 1), ahead AS (SELECT timestamp, "
    "coalesce(sum(n) OVER (ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) "
    "OVER () AS total FROM per_hour), cut AS (SELECT min(timestamp) AS c FROM ahead WHERE before >= total * 0.8) "
    "SELECT count(*) FILTER (WHERE timestamp < c) AS train_rows, count(*) FILTER (WHERE timestamp >= c) AS test_rows, "
    "min(c) AS cut FROM rows, cut"
)
def chronological_split(t):
    """Sizes of the two parts and the cut between them."""
    rows = drop_rows(t)
    cut = features.chronological_cut(rows).scalar()
    train, test = features.chronological_split(rows)
    sizes = train.agg(F.count(F.lit(1)).alias("train_rows"))
    return sizes.withColumns({"test_rows": test.agg(F.count(F.lit(1))).scalar(), "cut": cut})


_ROLLED = ", ".join(
    f"CASE WHEN count(internet) OVER w{n} = {n} THEN {f}(internet) OVER w{n} END AS internet_roll_{name}_{n}"
    for n in (3, 24)
    for f, name in (("avg", "mean"), ("stddev_samp", "std"))
)
_FORECAST = (
    f"{_neighbors_sql('internet_activity', 'neighbor_mean_internet_t')}, days AS (SELECT date, CAST(row_number() OVER "
    "(ORDER BY date) - 1 AS INTEGER) AS day_idx FROM (SELECT DISTINCT date FROM hourly)), base AS (SELECT h.grid_id, "
    "timestamp, date, day_idx * 24 + hour AS hour_index, internet_activity AS internet, total_calls, total_sms, "
    "neighbor_mean_internet_t FROM hourly h JOIN days USING (date) JOIN neighbors USING (grid_id, timestamp)), lagged AS "
    "(SELECT *, internet AS internet_lag1, lag(internet, 1) OVER s AS internet_lag2, lag(internet, 2) OVER s AS "
    f"internet_lag3, lag(internet, 23) OVER s AS internet_lag24, {_ROLLED}, total_calls AS calls_lag1, total_sms AS "
    "sms_lag1, lead(internet) OVER s AS internet_target, hour_index + 1 AS target_hour_index FROM base WINDOW s AS "
    f"({_SERIES}), w3 AS ({_SERIES} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w24 AS ({_SERIES} ROWS BETWEEN 23 "
    "PRECEDING AND CURRENT ROW)), forecast AS (SELECT l.*, d.date AS target_date, sin(2 * pi() * (target_hour_index % 24) "
    "/ 24.0) AS hour_sin, cos(2 * pi() * (target_hour_index % 24) / 24.0) AS hour_cos, sin(2 * pi() * (((SELECT "
    "isodow(min(date)) - 1 FROM days) + target_hour_index // 24) % 7) / 7.0) AS dow_sin, cos(2 * pi() * (((SELECT "
    "isodow(min(date)) - 1 FROM days) + target_hour_index // 24) % 7) / 7.0) AS dow_cos FROM lagged l LEFT JOIN days d ON "
    "l.target_hour_index // 24 = d.day_idx)"
)
_FORECAST_DOUBLES = (
    "internet_target", "internet_lag1", "internet_lag2", "internet_lag3", "internet_lag24", "internet_roll_mean_3",
    "internet_roll_std_3", "internet_roll_mean_24", "internet_roll_std_24", "calls_lag1", "sms_lag1",
    "neighbor_mean_internet_t", "hour_sin", "hour_cos", "dow_sin", "dow_cos",
)
_FORECAST_SELECT = (
    "SELECT grid_id, timestamp, date, hour_index, target_hour_index, target_date, -1 AS cell_cluster, "
    + ", ".join(f"ROUND({name}, 6) AS {name}" for name in _FORECAST_DOUBLES)
    + " FROM forecast"
)


@query(f"{_HOURLY}, {_FORECAST} {_FORECAST_SELECT}")
def forecast_features(t):
    return rounded(features.forecast_features(t.hourly(), width=WIDTH), 6)


def zone_forecast_rows(t):
    table = features.forecast_features(t.hourly("zone"), width=WIDTH)
    return rounded(features.forecast_training_rows(table), 6)


ZONE_ROWS_SQL = f"{_ZONES}, {_FORECAST}, rows AS ({_FORECAST_SELECT} WHERE " + " AND ".join(
    f"{name} IS NOT NULL" for name in _FORECAST_DOUBLES
) + ")"


@query(
    f"{ZONE_ROWS_SQL} SELECT count(*) AS rows, count(*) FILTER (WHERE target_hour_index - hour_index <> 1) AS "
    "misaligned_rows FROM rows"
)
def leakage_check(t):
    return features.leakage_check(zone_forecast_rows(t))


@query(
    f"{ZONE_ROWS_SQL}, target_days AS (SELECT target_date, row_number() OVER (ORDER BY target_date) AS i, count(*) OVER () AS n "
    "FROM (SELECT DISTINCT target_date FROM rows)), parts AS (SELECT target_date, CASE WHEN i <= n - 2 * greatest(1, "
    "round_even(n * 0.2, 0)) THEN 'train' WHEN i <= n - greatest(1, round_even(n * 0.2, 0)) THEN 'validation' ELSE 'test' "
    "END AS part FROM target_days) SELECT part, count(*) AS rows FROM rows JOIN parts USING (target_date) GROUP BY 1"
)
def split_by_target_date(t):
    """Size of every part."""
    rows = zone_forecast_rows(t)
    return features.with_part(rows, *features.date_parts(rows)).groupBy("part").agg(F.count(F.lit(1)).alias("rows"))


@query(
    f"{_HOURLY}, days AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS day_idx FROM (SELECT "
    "DISTINCT date FROM hourly)) SELECT grid_id, timestamp, day_idx, day_idx * 24 + hour AS hour_index FROM hourly JOIN "
    "days USING (date)"
)
def hour_index(t):
    return features.with_hour_index(t.hourly()).select("grid_id", "timestamp", "day_idx", "hour_index")


_PROFILE_SUMS = " + ".join(f"h{h:02d}" for h in range(24))


@query(
    f"{_HOURLY}, p AS (SELECT grid_id, "
    + ", ".join(
        f"coalesce(avg(internet_activity) FILTER (WHERE hour = {h}), 0) AS h{h:02d}" for h in range(24)
    )
    + f" FROM hourly WHERE date <= DATE '2024-01-20' GROUP BY grid_id), s AS (SELECT *, CASE WHEN {_PROFILE_SUMS} = 0 "
    f"THEN 1 ELSE {_PROFILE_SUMS} END AS total FROM p) SELECT grid_id, "
    + ", ".join(f"ROUND(h{h:02d} / total, 6) AS h{h:02d}" for h in range(24))
    + " FROM s"
)
def hourly_profiles(t):
    early = t.hourly().where(F.col("date") <= F.lit("2024-01-20").cast("date"))
    return rounded(features.hourly_profiles(early), 6)


_SUMMARY_COLUMNS = (
    "avg_activity", "activity_growth", "active_hours", "peak_ratio", "variability", "internet_share_at_t",
)


@query(
    f"{DROP_ROWS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS feature, ROUND(avg({name}), 4) AS avg, CAST(min({name}) AS DOUBLE) AS min, "
        f"CAST(max({name}) AS DOUBLE) AS max FROM rows"
        for name in _SUMMARY_COLUMNS
    )
)
def feature_summary(t):
    summary = features.feature_summary(drop_rows(t))
    return summary.withColumn("avg", F.round("avg", 4))


@query(f"{_HOURLY}, {_neighbors_sql('total_activity', 'm')} SELECT grid_id, timestamp, ROUND(m, 6) AS m FROM neighbors")
def lattice_neighbor_mean(t):
    table = t.hourly().select("grid_id", "timestamp", "total_activity")
    mean = spatial.with_lattice_neighbor_mean(table, "total_activity", "m", WIDTH)
    return rounded(mean.select("grid_id", "timestamp", "m"), 6)


_EDGES = (
    f"cells AS (SELECT DISTINCT user_id + 1 AS grid_id, user_id % {WIDTH} AS x, user_id // {WIDTH} AS y FROM events), "
    "edges AS (SELECT a.grid_id, b.grid_id AS neighbor_id FROM cells a JOIN cells b ON abs(a.x - b.x) <= 1 AND "
    "abs(a.y - b.y) <= 1 AND a.grid_id <> b.grid_id)"
)


def _cells(t):
    return t.read("events").select((F.col("user_id") + 1).alias("grid_id")).distinct()


@query(
    f"WITH cells AS (SELECT DISTINCT user_id + 1 AS grid_id, user_id % {WIDTH} AS x, user_id // {WIDTH} AS y FROM events), "
    "steps AS (SELECT * FROM (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) s(dx, dy)) "
    f"SELECT grid_id, (y + dy) * {WIDTH} + x + dx + 1 AS neighbor_id FROM cells, steps WHERE x + dx BETWEEN 0 AND "
    f"{WIDTH - 1} AND y + dy BETWEEN 0 AND (SELECT max(y) FROM cells)"
)
def lattice_edges(t):
    return spatial.lattice_edges(_cells(t), WIDTH)


@query(f"{_HOURLY}, {_neighbors_sql('internet_activity', 'm')} SELECT grid_id, timestamp, ROUND(m, 6) AS m FROM neighbors")
def edge_neighbor_mean(t):
    edges = spatial.lattice_edges(_cells(t), WIDTH)
    table = t.hourly().select("grid_id", "timestamp", "internet_activity")
    mean = spatial.with_edge_neighbor_mean(table, edges, "internet_activity", "m")
    return rounded(mean.select("grid_id", "timestamp", "m"), 6)


_POINTS = (
    f"points AS (SELECT c_custkey + 1 AS grid_id, CAST(c_custkey % {WIDTH} AS DOUBLE) + c_acctbal * 1e-6::DOUBLE AS x, "
    f"CAST(c_custkey // {WIDTH} AS DOUBLE) AS y FROM customer), pairs AS (SELECT a.grid_id, b.grid_id AS neighbor_id, "
    "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance FROM points a JOIN points b ON a.grid_id <> b.grid_id "
    "AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3), nearest AS (SELECT grid_id, min(distance) AS distance FROM pairs "
    "GROUP BY grid_id)"
)


@query(f"WITH {_POINTS} SELECT grid_id, ROUND(distance, 8) AS distance FROM nearest")
def nearest_distances(t):
    return rounded(spatial.nearest_distances(t.points()), 8)


@query(f"WITH {_POINTS} SELECT ROUND(median(distance), 8) AS value FROM nearest")
def grid_step(t):
    return rounded(spatial.grid_step(t.points()), 8)


@query(
    f"WITH {_POINTS}, ranked AS (SELECT grid_id, neighbor_id, distance, row_number() OVER (PARTITION BY grid_id ORDER BY "
    "distance, neighbor_id) AS r FROM pairs WHERE distance <= (SELECT median(distance) * 1.5::DOUBLE FROM nearest)) "
    "SELECT grid_id, neighbor_id, ROUND(distance, 8) AS distance FROM ranked WHERE r <= 8"
)
def distance_edges(t):
    return rounded(spatial.distance_edges(t.points()), 8)


@query("SELECT ROUND(quantile_cont(l_extendedprice, 0.05), 6) AS value FROM lineitem")
def price_percentile(t):
    """Exact 5th percentile over all line items."""
    return rounded(exact_percentile(t.read("lineitem"), "l_extendedprice", 0.05), 6)


@query(f"{with_shipments_hourly()} SELECT ROUND(median(total_activity), 6) AS value FROM hourly")
def median_activity(t):
    return rounded(exact_median(t.shipments_hourly(), "total_activity"), 6)
