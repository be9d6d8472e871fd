"""Profiles, checks and gates, each in as few scans as its counts allow."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide import texts
from gridtide.functions.columns import ratio_or_null
from gridtide.schemas import (
    CLEAN_COLUMNS,
    HOURLY_COLUMNS,
    HOURLY_MEASURES,
    HOURS_PER_DAY,
    MAX_GRID,
    MEASURES,
    MIN_GRID,
    RAW_MEASURES,
    TOTALS,
    require_columns,
)


def ingestion_profile(raw, file_column="input_file_name", low=MIN_GRID, high=MAX_GRID):
    """One row about raw usage records: rows, files, cells, country codes, times.

    A NULL cell, country or time counts as one distinct value.
    """

    def distinct(name):
        return F.count_distinct(F.col(name)) + F.max(F.col(name).isNull().cast("int"))

    return raw.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct(F.col(file_column)).alias("source_files"),
        F.count_if(F.col(file_column).isNull()).alias("missing_file_names"),
        distinct("CellID").alias("unique_grids"),
        F.count_if((F.col("CellID") < low) | (F.col("CellID") > high)).alias("invalid_grids"),
        distinct("countrycode").alias("country_codes"),
        distinct("datetime").alias("distinct_datetimes"),
    )


def partition_count(df):
    """One row: number of partitions that hold rows."""
    return df.select(F.spark_partition_id().alias("p")).agg(F.count_distinct("p").alias("partitions"))


def null_profile(df, columns=MEASURES):
    """One row: NULL count and percentage of every column."""
    rows = F.count(F.lit(1))
    counts = [F.count_if(F.col(name).isNull()).alias(f"{name}_nulls") for name in columns]
    shares = [
        (ratio_or_null(F.count_if(F.col(name).isNull()), rows) * 100).alias(f"{name}_null_pct")
        for name in columns
    ]
    return df.agg(*counts, *shares)


def hour_coverage(df):
    """Distinct hours seen per date."""
    return df.groupBy("date").agg(F.count_distinct("hour").alias("distinct_hours"))


def cadence(df, by=(), points=HOURS_PER_DAY):
    """Whether the distinct timestamps are exactly one hour apart and `points` in number.

    With a common offset inside the hour, n distinct times spanning n-1 hours can only be consecutive
    hours, so minimum, maximum and the distinct count decide it without ordering the timestamps.
    """
    seconds = F.unix_micros("timestamp")
    hour = 3_600_000_000
    distinct = df.where(F.col("timestamp").isNotNull()).select(*by, "timestamp").distinct()
    found = distinct.groupBy(*by).agg(
        F.count(F.lit(1)).alias("unique_timestamps"),
        F.min(seconds).alias("first"),
        F.max(seconds).alias("last"),
        (F.min(F.pmod(seconds, F.lit(hour))) == F.max(F.pmod(seconds, F.lit(hour)))).alias("aligned"),
    )
    spacing = (
        (F.col("unique_timestamps") > 1)
        & F.col("aligned")
        & (F.col("last") - F.col("first") == (F.col("unique_timestamps") - 1) * hour)
    )
    return found.select(
        *by,
        "unique_timestamps",
        F.coalesce(spacing, F.lit(False)).alias("is_hourly_spacing"),
        (F.col("unique_timestamps") == points).alias("is_24_points"),
        (F.coalesce(spacing, F.lit(False)) & (F.col("unique_timestamps") == points)).alias("cadence_ok"),
    )


def grain(df, by=()):
    """Average and maximum number of country rows per cell and time; above one confirms the grain."""
    per_slot = df.groupBy(*by, "timestamp", "grid_id").agg(F.count("country_code").alias("n"))
    return per_slot.groupBy(*by).agg(
        F.avg("n").alias("avg_country_rows_per_grid_hour"),
        F.max("n").alias("max_country_rows_per_grid_hour"),
        (F.max("n") > 1).alias("grain_confirmed"),
    )


def kpi_profile(clean, raw_counts, by="source"):
    """Profile of every source file: identity, cadence, grain, busiest hour and cell, counts of raw rows.

    `raw_counts` has one row per source, as `clean.batch_counts` gives it; copies are the loaded rows
    that were neither dropped nor kept.

    Cleaned rows are first reduced to one row per source, time and cell; hours, cells and times are then
    totalled together as grouping sets, so everything but the countries comes from one pass.
    """
    activity = sum((F.col(name) for name in MEASURES[1:]), F.col(MEASURES[0]))
    slots = clean.groupBy(by, "timestamp", "grid_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count("country_code").alias("countries"), F.sum(activity).alias("a")
    )
    slots = slots.withColumn("hour", F.hour("timestamp"))
    keys = ("hour", "grid_id", "timestamp")
    sets = slots.groupingSets([[F.col(by), F.col(key)] for key in keys], by, *keys).agg(
        F.sum("a").alias("a"),
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("slots"),
        F.sum("countries").alias("countries"),
        F.max("countries").alias("most"),
        *[F.grouping(key).alias(f"no_{key}") for key in keys],
    )
    is_hour, is_cell, is_time = [F.col(f"no_{key}") == 0 for key in keys]

    def best(kind, key):
        return F.max(F.when(kind, F.struct(F.col("a"), (-F.col(key)).alias("k"))))

    hour = 3_600_000_000
    micros = F.when(is_time, F.unix_micros("timestamp"))
    offset = F.pmod(micros, F.lit(hour))
    per_source = sets.groupBy(by).agg(
        F.count_if(is_cell).alias("unique_grids"),
        F.min("timestamp").alias("time_range_start"),
        F.max("timestamp").alias("time_range_end"),
        F.sum(F.when(is_hour, F.col("rows"))).alias("rows_cleaned"),
        F.count_if(is_time).alias("unique_timestamps"),
        ((F.min(offset) == F.max(offset)) & (F.max(micros) - F.min(micros) == 23 * hour)).alias("full_span"),
        F.sum(F.when(is_hour, F.col("countries"))).alias("countries"),
        F.sum(F.when(is_hour, F.col("slots"))).alias("slots"),
        F.max("most").alias("max_country_rows_per_grid_hour"),
        best(is_hour, "hour").alias("h"),
        best(is_cell, "grid_id").alias("g"),
    )
    profile = per_source.select(
        by,
        "unique_grids",
        "time_range_start",
        "time_range_end",
        "rows_cleaned",
        "unique_timestamps",
        ((F.col("unique_timestamps") == HOURS_PER_DAY) & F.col("full_span")).alias("cadence_ok"),
        ratio_or_null("countries", "slots").alias("avg_country_rows_per_grid_hour"),
        "max_country_rows_per_grid_hour",
        (F.col("max_country_rows_per_grid_hour") > 1).alias("raw_grain_confirmed"),
        (-F.col("h.k")).alias("busiest_hour"),
        F.col("h.a").alias("busiest_hour_total_activity"),
        (-F.col("g.k")).alias("busiest_grid_id"),
        F.col("g.a").alias("busiest_grid_total_activity"),
    )
    countries = clean.groupBy(by).agg(F.count_distinct("country_code").alias("country_code_categories"))
    # All three are as long as the list of sources; one without any clean row keeps its raw counts.
    joined = raw_counts.join(profile, by, "left").join(countries, by, "left")
    kept = F.coalesce("rows_cleaned", F.lit(0))
    copies = F.col("rows_loaded") - F.col("rows_dropped_missing_identity") - kept
    return joined.withColumn("rows_dropped_duplicates", copies)


def duplicate_keys(df, keys=("grid_id", "timestamp")):
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def size_bounds(clean, hourly, cells=MAX_GRID):
    """One row: the summary is smaller than its input and within days x 24 x cells."""
    raw = clean.agg(F.count(F.lit(1)).alias("n"))
    summary = hourly.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("days"))
    limit = F.col("days") * HOURS_PER_DAY * cells
    return summary.select(
        raw.scalar().alias("clean_rows"),
        F.col("n").alias("summary_rows"),
        limit.alias("upper_bound"),
        (F.col("n") < raw.scalar()).alias("is_reduced"),
        (F.col("n") <= limit).alias("is_within_bound"),
    )


def compare_tables(left, right, keys, values, tolerance=1e-6):
    """One row: keys missing on either side and keys whose values differ beyond the tolerance."""
    both = (
        left.select(*keys, *[F.col(v).alias(f"l_{v}") for v in values], F.lit(1).alias("in_left"))
        .join(
            right.select(*keys, *[F.col(v).alias(f"r_{v}") for v in values], F.lit(1).alias("in_right")),
            list(keys),
            "full",
        )
    )
    differs = F.lit(False)
    for name in values:
        gap = F.abs(F.col(f"l_{name}") - F.col(f"r_{name}"))
        differs = differs | F.coalesce(gap > tolerance, ~F.col(f"l_{name}").eqNullSafe(F.col(f"r_{name}")))
    matched = F.col("in_left").isNotNull() & F.col("in_right").isNotNull()
    return both.agg(
        F.count_if(matched).alias("matched_keys"),
        F.count_if(F.col("in_right").isNull()).alias("only_left"),
        F.count_if(F.col("in_left").isNull()).alias("only_right"),
        F.count_if(matched & differs).alias("different"),
    )


def enrichment_coverage(hourly, enriched):
    """One row: cells before and after enrichment, cells without geometry, rows before and after."""
    per_cell = (
        enriched.where(F.col("grid_id").isNotNull())
        .groupBy("grid_id")
        .agg(F.count_if(F.col("geometry").isNull()).alias("bare"), F.count(F.lit(1)).alias("rows"))
    )
    before = hourly.where(F.col("grid_id").isNotNull()).agg(
        F.struct(F.count_distinct("grid_id").alias("cells"), F.count(F.lit(1)).alias("rows")).alias("s")
    )
    after = per_cell.agg(
        F.count(F.lit(1)).alias("distinct_after"),
        F.count_if(F.col("bare") > 0).alias("missing_geometry_grids"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_after"),
    )
    source = before.scalar()
    share = ratio_or_null(source["cells"] - F.col("missing_geometry_grids"), source["cells"]) * 100
    return after.select(
        source["cells"].alias("distinct_before"),
        "distinct_after",
        "missing_geometry_grids",
        F.coalesce(share, F.lit(0.0)).alias("enriched_pct"),
        source["rows"].alias("rows_before"),
        "rows_after",
        (source["rows"] == F.col("rows_after")).alias("rows_preserved"),
    )


def content_counts():
    """Aggregates behind the verdict of a source; the raw columns hold text."""
    counts = [
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.try_to_timestamp("datetime").isNull()).alias("bad_time"),
        F.count_if(F.col("CellID").isNull()).alias("no_cell"),
    ]
    for name in RAW_MEASURES:
        number = F.col(name).try_cast("double")
        counts.append(F.count_if(number.isNull() & F.col(name).isNotNull()).alias(f"{name}_text"))
        counts.append(F.count_if(number < 0).alias(f"{name}_negative"))
    return counts


def content_gate(rows, by="source"):
    """Verdict of every source from its cells as text; the first failing check gives the reason.

    Order of the checks: no rows, malformed time, missing cell, then per measure non-numeric and
    negative values. `rows` holds the raw columns as strings.
    """
    return verdicts(rows.groupBy(by).agg(*content_counts())).select(by, "status", "row_count", "reason")


def verdicts(counted):
    """Status and reason from the per-source counts of `content_gate`."""

    def text(message, column):
        return F.concat(F.lit(message), F.col(column).cast("string"))

    reason = F.when(F.col("row_count") == 0, texts.NO_ROWS)
    reason = reason.when(F.col("bad_time") > 0, text(texts.BAD_TIME, "bad_time"))
    reason = reason.when(F.col("no_cell") > 0, text(texts.NO_CELL, "no_cell"))
    for name in RAW_MEASURES:
        reason = reason.when(
            F.col(f"{name}_text") > 0,
            text(texts.NOT_NUMERIC.format(name=name), f"{name}_text"),
        ).when(
            F.col(f"{name}_negative") > 0,
            text(texts.NEGATIVE.format(name=name), f"{name}_negative"),
        )
    return counted.withColumn("reason", reason.otherwise(texts.CHECKS_PASSED)).withColumn(
        "status", F.when(F.col("reason") == texts.CHECKS_PASSED, "VALID").otherwise("REJECTED")
    )


def gate_counts():
    """What the gate counts per layer: {layer: aggregates}, to be taken by a scan or while the layer is written."""
    rows = F.count(F.lit(1)).alias("rows")
    null_keys = F.count_if(F.col("grid_id").isNull() | F.col("timestamp").isNull()).alias("null_keys")

    def negatives(names):
        return [F.count_if(F.col(name) < 0).alias(f"negative_{name}") for name in names]

    return {
        "clean": [rows, null_keys, *negatives(MEASURES)],
        "hourly": [rows, null_keys, *negatives((*HOURLY_MEASURES, *TOTALS))],
        "enriched": [rows, F.count_if(F.col("geometry").isNull()).alias("missing_geometry")],
    }


def _gate_rules(base, names):
    """Rule rows from one row that holds the counts of every layer as a struct; `names` lists them per layer."""

    def count(layer, name):
        return F.col(f"{layer}.{name}")

    rows_out, rows_hourly = count("flow", "rows_out"), count("hourly", "rows")
    derived = {
        ("flow", "no_output_rows"): (rows_out == 0).cast("long"),
        ("flow", "rejected_rows"): count("flow", "rows_rejected"),
        ("flow", "row_count_mismatch"): F.abs(count("flow", "rows_in") - rows_out - count("flow", "rows_rejected")),
        ("hourly", "empty"): (rows_hourly == 0).cast("long"),
        ("hourly", "more_rows_than_input"): F.greatest(rows_hourly - rows_out, F.lit(0).cast("long")),
        ("enriched", "empty"): (count("enriched", "rows") == 0).cast("long"),
        ("enriched", "changed_row_count"): F.abs(count("enriched", "rows") - rows_hourly),
    }
    for layer in ("clean", "hourly", "enriched"):
        derived.update({(layer, name): count(layer, name) for name in names[layer] if name != "rows"})
    rules = F.array(
        *[
            F.struct(
                F.lit(layer).alias("layer"),
                F.lit(rule).alias("rule"),
                violations.alias("violations"),
                (violations == 0).alias("passed"),
            )
            for (layer, rule), violations in derived.items()
        ]
    )
    return base.select(F.inline(rules))


def quality_gate(report, clean, hourly, enriched):
    """One row per rule of the daily run: layer, rule, violations and whether it passed.

    Each of the four inputs is reduced to one row by a subquery of its own, so it is read once; the
    rules are then expressions over those rows. Schema rules are decided without a scan.
    """
    require_columns(clean, CLEAN_COLUMNS)
    require_columns(hourly, HOURLY_COLUMNS)
    tables, wanted = {"clean": clean, "hourly": hourly, "enriched": enriched}, gate_counts()
    rows = {"flow": report} | {layer: df.agg(*wanted[layer]) for layer, df in tables.items()}
    values = {layer: row.select(F.struct(*row.columns).alias("s")).scalar() for layer, row in rows.items()}
    base = clean.sparkSession.range(1).select(*[value.alias(layer) for layer, value in values.items()])
    return _gate_rules(base, {layer: row.columns for layer, row in rows.items()})


def gate_of_counts(spark, counts):
    """The rules of `quality_gate` from counts that the writes have taken: {"flow" or layer: {name: number}}."""
    structs = [F.struct(*[F.lit(int(n or 0)).cast("long").alias(name) for name, n in row.items()]).alias(layer) for layer, row in counts.items()]
    return _gate_rules(spark.range(1).select(*structs), {layer: list(row) for layer, row in counts.items()})


def require_passed(rules):
    """Raise with every failed rule; the rule table has a fixed, small number of rows."""
    failed = rules.where(~F.col("passed")).collect()
    if failed:
        text = "; ".join(f"{row.layer}.{row.rule}={row.violations}" for row in failed)
        raise ValueError(f"quality check failed, {len(failed)} rule(s): {text}")


def table_counts(tables):
    """Row count of every named table and whether it is non-empty."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts.withColumn("passed", F.col("rows") > 0)


def require_tables(tables):
    """Raise when any of the named tables is empty."""
    empty = [row.table_name for row in table_counts(tables).where(~F.col("passed")).collect()]
    if empty:
        raise ValueError(f"empty tables: {empty}")


def partial_days(hourly, expected=HOURS_PER_DAY):
    """Cell days whose distinct hours differ from the expected number."""
    hours = hourly.groupBy("grid_id", "date").agg(
        F.count_distinct("hour").alias("distinct_hours"), F.count(F.lit(1)).alias("rows")
    )
    return hours.where(F.col("distinct_hours") != expected)


def with_hours_in_day(hourly):
    """Add the number of distinct hours of the cell's day.

    Distinct hours are counted by flagging the first row of each hour, in the (cell, date) partitioning
    that the other day windows use as well.
    """
    day = Window.partitionBy("grid_id", "date")
    is_new = F.coalesce(F.lag("hour").over(day.orderBy("hour")) != F.col("hour"), F.lit(True)).cast("int")
    return hourly.withColumn("__new", is_new).withColumn("hours_in_day", F.sum("__new").over(day)).drop("__new")


def rows_in_partial_days(hourly, expected=HOURS_PER_DAY):
    """Rows that belong to a partial cell day."""
    return with_hours_in_day(hourly).where(F.col("hours_in_day") != expected).drop("hours_in_day")


def rows_in_full_days(hourly, expected=HOURS_PER_DAY):
    return with_hours_in_day(hourly).where(F.col("hours_in_day") == expected).drop("hours_in_day")
