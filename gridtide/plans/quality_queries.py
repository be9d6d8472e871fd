"""Queries over profiles, checks and gates."""

from pyspark.sql import functions as F

from gridtide.functions.sizes import scratch_path
from gridtide.operators import clean, enrich, hourly, quality
from gridtide.plans import daily
from gridtide.plans.binding import (
    CALENDAR_SQL,
    CELLS_SQL,
    CLEAN_SQL,
    DIRTY_SQL,
    FACT_SQL,
    GEOMETRY_SQL,
    SCALE,
    TIMES_SQL,
    hourly_sql,
    rounded,
    usage_sql,
    with_hourly,
)
from gridtide.plans.catalog import query
from gridtide.sources import sinks
from gridtide.schemas import HOURLY_MEASURES, MEASURES, RAW_MEASURES, TOTALS

_CLEAN = f"WITH {usage_sql()}, {CLEAN_SQL}"


@query(
    f"WITH {usage_sql()} SELECT count(*) AS total_rows, count(DISTINCT CAST(timestamp AS DATE)) AS source_files, "
    "CAST(0 AS BIGINT) AS missing_file_names, count(DISTINCT grid_id) AS unique_grids, "
    "count(*) FILTER (WHERE grid_id < 1 OR grid_id > 10000) AS invalid_grids, count(DISTINCT country_code) AS "
    "country_codes, count(DISTINCT timestamp) AS distinct_datetimes FROM usage"
)
def ingestion_profile(t):
    return quality.ingestion_profile(t.raw(), file_column="source")


@query(
    f"WITH {usage_sql()}, {DIRTY_SQL} SELECT "
    + ", ".join(f"count(*) FILTER (WHERE {name} IS NULL) AS {name}_nulls" for name in MEASURES)
    + ", "
    + ", ".join(
        f"ROUND(count(*) FILTER (WHERE {name} IS NULL) / count(*) * 100, 6) AS {name}_null_pct" for name in MEASURES
    )
    + " FROM dirty"
)
def null_profile(t):
    return rounded(quality.null_profile(t.dirty_usage()), 6)


@query(f"{_CLEAN} SELECT date, count(DISTINCT hour) AS distinct_hours FROM clean GROUP BY date")
def hour_coverage(t):
    return quality.hour_coverage(t.clean())


_CADENCE = (
    "stamps AS (SELECT DISTINCT date, timestamp FROM clean), gaps AS (SELECT date, timestamp, timestamp - "
    "lag(timestamp) OVER (PARTITION BY date ORDER BY timestamp) AS gap FROM stamps), cadence AS (SELECT date, "
    "count(*) AS unique_timestamps, count(*) > 1 AND count(*) FILTER (WHERE gap <> INTERVAL 1 HOUR) = 0 "
    "AS is_hourly_spacing, count(*) = 24 AS is_24_points FROM gaps GROUP BY date)"
)


@query(f"{_CLEAN}, {_CADENCE} SELECT *, is_hourly_spacing AND is_24_points AS cadence_ok FROM cadence")
def cadence_per_date(t):
    return quality.cadence(t.clean(), by=("date",))


@query(
    f"{_CLEAN}, stamps AS (SELECT DISTINCT timestamp FROM clean), gaps AS (SELECT timestamp - lag(timestamp) OVER "
    "(ORDER BY timestamp) AS gap FROM stamps) SELECT count(*) AS unique_timestamps, count(*) > 1 AND count(*) FILTER "
    "(WHERE gap <> INTERVAL 1 HOUR) = 0 AS is_hourly_spacing, count(*) = 24 AS is_24_points, count(*) > 1 AND "
    "count(*) FILTER (WHERE gap <> INTERVAL 1 HOUR) = 0 AND count(*) = 24 AS cadence_ok FROM gaps"
)
def cadence_overall(t):
    return quality.cadence(t.clean())


_GRAIN = (
    "slots AS (SELECT date, timestamp, grid_id, count(country_code) AS n FROM clean GROUP BY 1, 2, 3), grain AS "
    "(SELECT date, ROUND(avg(n), 6) AS avg_country_rows_per_grid_hour, max(n) AS max_country_rows_per_grid_hour, "
    "max(n) > 1 AS grain_confirmed FROM slots GROUP BY date)"
)


@query(f"{_CLEAN}, {_GRAIN} SELECT * FROM grain")
def grain_per_date(t):
    return rounded(quality.grain(t.clean(), by=("date",)), 6)


_TOTAL = " + ".join(MEASURES)


def _arg_max_sql(key, name):
    return (
        f"{name}_sums AS (SELECT date, {key} AS k, ROUND(sum({_TOTAL}), 4) AS t FROM clean GROUP BY 1, 2), "
        f"{name} AS (SELECT date, k AS {name}, t AS {name}_total_activity FROM {name}_sums QUALIFY row_number() OVER "
        "(PARTITION BY date ORDER BY t DESC, k) = 1)"
    )


@query(
    f"{_CLEAN}, {_CADENCE}, {_GRAIN}, {_arg_max_sql('hour', 'busiest_hour')}, "
    f"{_arg_max_sql('grid_id', 'busiest_grid_id')}, identity AS (SELECT date, count(DISTINCT grid_id) AS unique_grids, "
    "min(timestamp) AS time_range_start, max(timestamp) AS time_range_end, count(DISTINCT country_code) AS "
    "country_code_categories, count(*) AS rows_cleaned FROM clean GROUP BY date), nulls AS (SELECT CAST(timestamp AS "
    "DATE) AS date, count(*) AS rows_loaded, CAST(0 AS BIGINT) AS rows_dropped_missing_identity, count(*) FILTER (WHERE "
    + " OR ".join(f"{name} IS NULL" for name in MEASURES)
    + ") AS rows_with_missing_activity_filled, CAST(sum("
    + " + ".join(f"CASE WHEN {name} < 0 THEN 1 ELSE 0 END" for name in MEASURES)
    + ") AS BIGINT) AS negative_activity_cells_clipped, "
    + ", ".join(
        f"count(*) FILTER (WHERE {name} IS NULL) AS {name}_nulls"
        for name in ("timestamp", "grid_id", "country_code", *MEASURES)
    )
    + " FROM usage GROUP BY 1) SELECT i.*, unique_timestamps, is_hourly_spacing AND is_24_points AS cadence_ok, "
    "avg_country_rows_per_grid_hour, max_country_rows_per_grid_hour, grain_confirmed AS raw_grain_confirmed, busiest_hour, "
    "busiest_hour_total_activity, busiest_grid_id, busiest_grid_id_total_activity AS busiest_grid_total_activity, n.* EXCLUDE (date), rows_loaded - rows_cleaned AS rows_dropped_duplicates FROM identity i "
    "JOIN cadence USING (date) JOIN grain USING (date) JOIN busiest_hour USING (date) JOIN busiest_grid_id USING (date) "
    "JOIN nulls n USING (date)"
)
def profile_per_date(t):
    """Profile of every source, a source being one date."""
    raw = t.usage().withColumn("date", F.to_date("timestamp"))
    return rounded(quality.kpi_profile(t.clean(), clean.batch_counts(raw, by=("date",)), by="date"), 6)


@query(
    f"{_CLEAN} SELECT grid_id, timestamp, count(*) AS copies FROM clean GROUP BY 1, 2 HAVING count(*) > 1"
)
def duplicate_keys(t):
    return quality.duplicate_keys(t.clean())


@query(
    f"{with_hourly()}, n AS (SELECT (SELECT count(*) FROM clean) AS clean_rows, (SELECT count(*) FROM hourly) AS "
    "summary_rows, (SELECT count(DISTINCT date) FROM hourly) * 24 * 10000 AS upper_bound) SELECT *, summary_rows < "
    "clean_rows AS is_reduced, summary_rows <= upper_bound AS is_within_bound FROM n"
)
def size_bounds(t):
    return quality.size_bounds(t.clean(), t.hourly())


@query(
    f"{with_hourly()} SELECT count(*) AS matched_keys, CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right, "
    "CAST(0 AS BIGINT) AS different FROM hourly"
)
def recomputed_hourly_matches(t):
    """The hourly table against its recomputation with plain double sums, over all keys."""
    again = hourly.hourly_by_calendar(t.clean())
    values = (*HOURLY_MEASURES, *TOTALS)
    return quality.compare_tables(t.hourly(), again, ("grid_id", "timestamp"), values)


@query(
    f"{with_hourly()}, {GEOMETRY_SQL}, joined AS (SELECT h.grid_id, g.geometry FROM hourly h LEFT JOIN geometry g "
    "USING (grid_id)), n AS (SELECT (SELECT count(DISTINCT grid_id) FROM hourly) AS distinct_before, (SELECT "
    "count(DISTINCT grid_id) FROM joined) AS distinct_after, (SELECT count(DISTINCT grid_id) FROM joined WHERE geometry "
    "IS NULL) AS missing_geometry_grids, (SELECT count(*) FROM hourly) AS rows_before, (SELECT count(*) FROM joined) AS "
    "rows_after) SELECT *, ROUND((distinct_before - missing_geometry_grids) / distinct_before * 100, 6) AS enriched_pct, "
    "rows_before = rows_after AS rows_preserved FROM n"
)
def enrichment_coverage(t):
    table = t.hourly()
    return rounded(quality.enrichment_coverage(table, enrich.with_geometry(table, t.geometry())), 6)


def _gate_sql():
    numbers = [
        "count(*) AS row_count",
        "count(*) FILTER (WHERE try_strptime(datetime, '%Y-%m-%d %H:%M:%S') IS NULL) AS bad_time",
        "count(*) FILTER (WHERE CellID IS NULL) AS no_cell",
    ]
    cases = [
        "WHEN bad_time > 0 THEN 'Malformed timestamp values: ' || bad_time",
        "WHEN no_cell > 0 THEN 'Missing CellID values: ' || no_cell",
    ]
    for name in RAW_MEASURES:
        numbers.append(
            f"count(*) FILTER (WHERE TRY_CAST({name} AS DOUBLE) IS NULL AND {name} IS NOT NULL) AS {name}_text"
        )
        numbers.append(f"count(*) FILTER (WHERE TRY_CAST({name} AS DOUBLE) < 0) AS {name}_negative")
        cases.append(
            f"WHEN {name}_text > 0 THEN 'Non-numeric values found in activity column ''{name}'': ' || {name}_text"
        )
        cases.append(
            f"WHEN {name}_negative > 0 THEN 'Negative activity values found in ''{name}'': ' || {name}_negative"
        )
    measures = ", ".join(
        f"CASE WHEN {name} IS NOT NULL THEN CASE WHEN country_code = 2 AND {test} THEN 'n/a' ELSE "
        f"CAST({name} - CASE WHEN country_code = 3 THEN 1000 ELSE 0 END AS VARCHAR) END END AS {raw}"
        for raw, name, test in zip(
            RAW_MEASURES, MEASURES, ("CAST(day(timestamp) AS INTEGER) > 10",) * len(MEASURES)
        )
    )
    return (
        f"WITH {usage_sql()}, texts AS (SELECT grid_id AS source, CASE WHEN country_code = 1 THEN 'not a time' ELSE "
        "strftime(timestamp, '%Y-%m-%d %H:%M:%S') END AS datetime, CASE WHEN country_code <> 0 THEN CAST(grid_id AS "
        f"VARCHAR) END AS CellID, {measures} FROM usage), counted AS (SELECT source, {', '.join(numbers)} FROM texts "
        f"GROUP BY source), judged AS (SELECT source, row_count, CASE {' '.join(cases)} ELSE "
        "'Minimum quality checks passed' END AS reason FROM counted) SELECT source, CASE WHEN reason = 'Minimum quality "
        "checks passed' THEN 'VALID' ELSE 'REJECTED' END AS status, row_count, reason FROM judged"
    )


@query(_gate_sql())
def content_gate_per_source(t):
    """Verdict per source, a source being one cell, over text cells of which some are malformed."""
    usage = t.usage()
    code = F.col("country_code")
    text = {
        "source": F.col("grid_id"),
        "datetime": F.when(code == 1, "not a time").otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")),
        "CellID": F.when(code != 0, F.col("grid_id").cast("string")),
        "countrycode": code.cast("string"),
    }
    for raw, name in zip(RAW_MEASURES, MEASURES):
        shifted = (F.col(name) - F.when(code == 3, 1000).otherwise(0)).cast("string")
        bad = (code == 2) & (F.dayofmonth("timestamp") > 10)
        text[raw] = F.when(F.col(name).isNotNull(), F.when(bad, "n/a").otherwise(shifted))
    return quality.content_gate(usage.select(*[value.alias(name) for name, value in text.items()]))


def _rules_sql():
    def negatives(names):
        return [(f"negative_{name}", f"count(*) FILTER (WHERE {name} < 0)") for name in names]

    keys = "count(*) FILTER (WHERE grid_id IS NULL OR timestamp IS NULL)"
    kept = "(SELECT count(*) FROM dirty WHERE grid_id IS NOT NULL AND timestamp IS NOT NULL)"
    rows = "(SELECT count(*) FROM dirty)"
    grouped = "(SELECT count(*) FROM hourly)"
    parts = [
        ("flow", "no_output_rows", f"SELECT CASE WHEN {kept} = 0 THEN 1 ELSE 0 END"),
        ("flow", "rejected_rows", f"SELECT {rows} - {kept}"),
        ("flow", "row_count_mismatch", "SELECT 0"),
        *[("clean", n, f"SELECT {e} FROM clean") for n, e in [("null_keys", keys), *negatives(MEASURES)]],
        ("hourly", "empty", f"SELECT CASE WHEN {grouped} = 0 THEN 1 ELSE 0 END"),
        ("hourly", "more_rows_than_input", f"SELECT greatest({grouped} - {kept}, 0)"),
        *[
            ("hourly", n, f"SELECT {e} FROM hourly")
            for n, e in [("null_keys", keys), *negatives((*HOURLY_MEASURES, *TOTALS))]
        ],
        ("enriched", "empty", f"SELECT CASE WHEN {grouped} = 0 THEN 1 ELSE 0 END"),
        ("enriched", "changed_row_count", "SELECT 0"),
        (
            "enriched",
            "missing_geometry",
            "SELECT count(*) FROM hourly h LEFT JOIN geometry g USING (grid_id) WHERE g.geometry IS NULL",
        ),
    ]
    rules = " UNION ALL ".join(
        f"SELECT '{layer}' AS layer, '{rule}' AS rule, CAST(({sql}) AS BIGINT) AS violations" for layer, rule, sql in parts
    )
    filled = ", ".join(f"greatest(coalesce({name}, 0), 0) AS {name}" for name in MEASURES)
    return (
        f"WITH {usage_sql()}, {DIRTY_SQL}, clean AS (SELECT timestamp, grid_id, country_code, {filled}, {CALENDAR_SQL} "
        f"FROM dirty WHERE grid_id IS NOT NULL AND timestamp IS NOT NULL), {hourly_sql()}, {GEOMETRY_SQL}, "
        f"rules AS ({rules}) SELECT *, violations = 0 AS passed FROM rules"
    )


@query(_rules_sql())
def quality_gate(t):
    """All rules of the daily run over dirty input, from the counts of its writes; several of them fail."""
    path = scratch_path(t.spark)
    store = lambda name, df, by, aggregates: sinks.counted_table(df, f"{path}/{name}", aggregates)
    return daily.gated_layers(t.dirty_usage(), t.geometry(), store, SCALE).rules


@query(
    f"{with_hourly()}, {TIMES_SQL}, {FACT_SQL}, {CELLS_SQL}, n AS (SELECT 'dim_grid' AS table_name, count(*) AS rows "
    "FROM cells UNION ALL SELECT 'dim_time', count(*) FROM times UNION ALL SELECT 'fact_network_activity', count(*) "
    "FROM fact) SELECT *, rows > 0 AS passed FROM n"
)
def warehouse_counts(t):
    tables = {"dim_grid": t.cells(), "dim_time": t.times(), "fact_network_activity": t.fact()}
    return quality.table_counts(tables)
