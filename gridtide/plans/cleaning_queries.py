"""Queries over renaming, typing, quarantine, cleaning and filters."""

from pyspark.sql import functions as F

from gridtide.functions.columns import (
    cycle_cos,
    cycle_sin,
    day_and_hour,
    lattice_id,
    lattice_x,
    lattice_y,
    severity,
)
from gridtide.operators import clean, hourly
from gridtide.plans.binding import (
    CLEAN_SQL,
    DIRTY_SQL,
    MEASURE_EVENTS,
    SHIPMENTS_SQL,
    WIDTH,
    rounded,
    usage_sql,
    with_hourly,
)
from gridtide.plans.catalog import query
from gridtide.schemas import MEASURES

_NEGATIVE = " OR ".join(f"coalesce({name}, 0) < 0" for name in MEASURES)
_INVALID = f"(grid_id IS NULL OR timestamp IS NULL OR {_NEGATIVE})"
_CLAMPED = ", ".join(f"greatest(coalesce({name}, 0), 0) AS {name}" for name in MEASURES)
_NULLS = " + ".join(f"CAST({name} IS NULL AS BIGINT)" for name in MEASURES)
_DIRTY = f"WITH {usage_sql()}, {DIRTY_SQL}"
_PARTS = (
    "CAST(timestamp AS DATE) AS date, CAST(hour(timestamp) AS INTEGER) AS hour, "
    "CAST(dayofweek(timestamp) + 1 AS INTEGER) AS day_of_week, CAST(isodow(timestamp) - 1 AS INTEGER) AS weekday"
)


@query(
    f"WITH {usage_sql()} SELECT CASE WHEN country_code <> 1 THEN timestamp END AS timestamp, "
    "CASE WHEN country_code <> 0 THEN grid_id END AS grid_id, country_code, "
    + ", ".join(f"CASE WHEN country_code <> 2 THEN {name} END AS {name}" for name in MEASURES)
    + " FROM usage"
)
def typed_usage(t):
    """Raw text cells under canonical names and types; malformed cells become NULL."""
    return clean.typed(clean.canonical_names(t.raw_text()), "yyyy-MM-dd HH:mm:ss")


@query(
    f"WITH {usage_sql()} SELECT timestamp, grid_id, coalesce(sms_in, 0) AS sms_in, coalesce(call_in, 0) AS call_in, "
    "CAST(0 AS DOUBLE) AS sms_out, CAST(0 AS DOUBLE) AS call_out, coalesce(internet, 0) AS internet_activity, "
    "CAST(timestamp AS DATE) AS date, CAST(hour(timestamp) AS INTEGER) AS hour FROM usage"
)
def loosely_named_usage(t):
    """Input with other producers' names and two absent measures."""
    loose = clean.nulls_to_zero(t.usage()).select(
        "timestamp",
        "grid_id",
        F.col("sms_in").alias("sms_in_count"),
        F.col("call_in").alias("call_in_count"),
        F.col("internet").alias("internet_usage"),
    )
    return clean.tolerant(loose)


@query(
    f"{_DIRTY} SELECT CAST(year(min(timestamp)) AS INTEGER) AS min_year, year(min(timestamp)) < 2000 AS suspicious "
    "FROM dirty"
)
def earliest_year(t):
    return clean.earliest_year(t.dirty_usage())


@query(
    f"{_DIRTY} SELECT count(*) AS raw_records, count(*) FILTER (WHERE {_INVALID}) AS rejected_records, "
    f"count(*) FILTER (WHERE NOT {_INVALID}) AS accepted_records FROM dirty"
)
def quarantine_counts(t):
    return clean.quarantine_counts(t.dirty_usage())


@query(f"{_DIRTY} SELECT timestamp, grid_id, country_code, {', '.join(MEASURES)} FROM dirty WHERE {_INVALID}")
def quarantined_rows(t):
    return clean.quarantine(t.dirty_usage()).rejected


@query(
    f"{_DIRTY} SELECT timestamp, grid_id, country_code, "
    + ", ".join(f"coalesce({name}, 0) AS {name}" for name in MEASURES)
    + f" FROM dirty WHERE NOT {_INVALID}"
)
def accepted_rows_filled(t):
    """Accepted rows with NULL measures filled."""
    return clean.nulls_to_zero(clean.quarantine(t.dirty_usage()).clean)


@query(f"{_DIRTY} SELECT CAST(sum({_NULLS}) AS BIGINT) AS handled_nulls FROM dirty WHERE NOT {_INVALID}")
def handled_nulls(t):
    return clean.quarantine(t.dirty_usage()).clean.agg(clean.handled_nulls().alias("handled_nulls"))


@query(
    "SELECT c_custkey, greatest(c_acctbal, 0) AS c_acctbal FROM customer"
)
def clamped_balances(t):
    """Negative values raised to zero."""
    return clean.clamp_negatives(t.read("customer").select("c_custkey", "c_acctbal"), ("c_acctbal",))


@query(
    f"{_DIRTY} SELECT timestamp, grid_id, country_code, {_CLAMPED}, {_PARTS} FROM dirty "
    "WHERE grid_id IS NOT NULL AND timestamp IS NOT NULL"
)
def cleaned_usage(t):
    return clean.clean_usage(t.dirty_usage()).clean


@query(
    f"{_DIRTY} SELECT count(*) AS rows_in, count(*) FILTER (WHERE grid_id IS NULL OR timestamp IS NULL) "
    f"AS rows_rejected, CAST(sum({_NULLS}) AS BIGINT) AS nulls_handled, "
    "count(*) FILTER (WHERE grid_id IS NOT NULL AND timestamp IS NOT NULL) AS rows_out FROM dirty"
)
def cleaning_report(t):
    return clean.clean_usage(t.dirty_usage()).report


_BATCH = (
    f"WITH {usage_sql()}, typed AS (SELECT CASE WHEN country_code <> 1 THEN timestamp END AS timestamp, "
    "CASE WHEN country_code <> 0 THEN grid_id END AS grid_id, country_code, "
    + ", ".join(f"CASE WHEN country_code <> 2 THEN {name} END AS {name}" for name in MEASURES)
    + " FROM usage)"
)


@query(
    f"{_BATCH} SELECT DISTINCT timestamp, grid_id, country_code, {_CLAMPED} FROM typed "
    "WHERE timestamp IS NOT NULL AND grid_id IS NOT NULL"
)
def cleaned_batch(t):
    return clean.clean_batch(t.raw_text(), pattern="yyyy-MM-dd HH:mm:ss")


@query(
    f"{_BATCH}, kept AS (SELECT timestamp, grid_id, country_code, {_CLAMPED} FROM typed "
    "WHERE timestamp IS NOT NULL AND grid_id IS NOT NULL) "
    "SELECT count(*) AS rows_loaded, count(*) FILTER (WHERE timestamp IS NULL OR grid_id IS NULL) "
    "AS rows_dropped_missing_identity, count(*) FILTER (WHERE timestamp IS NOT NULL AND grid_id IS NOT NULL AND ("
    + " OR ".join(f"{name} IS NULL" for name in MEASURES)
    + ")) AS rows_with_missing_activity_filled, CAST(sum(CASE WHEN timestamp IS NOT NULL AND grid_id IS NOT NULL "
    "THEN " + " + ".join(f"CASE WHEN {name} < 0 THEN 1 ELSE 0 END" for name in MEASURES)
    + " END) AS BIGINT) AS negative_activity_cells_clipped, "
    "(SELECT count(*) FROM kept) - (SELECT count(*) FROM (SELECT DISTINCT * FROM kept)) AS rows_dropped_duplicates "
    "FROM typed"
)
def batch_report(t):
    return clean.clean_batch_report(t.raw_text(), pattern="yyyy-MM-dd HH:mm:ss")


@query(
    f"WITH {usage_sql()}, {CLEAN_SQL}, s AS (SELECT timestamp, grid_id, country_code, sms_in + sms_out AS total_sms, "
    "call_in + call_out AS total_calls, internet FROM clean) SELECT timestamp, grid_id, country_code, total_sms, "
    "total_calls, total_sms + total_calls + internet AS total_activity FROM s"
)
def activity_totals(t):
    return clean.with_totals(t.clean()).select(
        "timestamp", "grid_id", "country_code", "total_sms", "total_calls", "total_activity"
    )


@query(f"WITH {usage_sql()} SELECT timestamp, grid_id, {_PARTS} FROM usage")
def calendar_parts(t):
    return clean.with_calendar(t.usage().select("timestamp", "grid_id"))


@query(
    f"{with_hourly()} SELECT timestamp, grid_id, total_activity FROM hourly WHERE timestamp >= "
    "TIMESTAMP '2024-01-10 06:00:00' AND timestamp <= TIMESTAMP '2024-01-12 18:00:00'"
)
def time_range(t):
    inside = clean.between_times(t.hourly(), "2024-01-10 06:00:00", "2024-01-12 18:00:00")
    return inside.select("timestamp", "grid_id", "total_activity")


@query(
    f"{with_hourly()} SELECT timestamp, grid_id, total_activity FROM hourly "
    "WHERE isodow(timestamp) = 5 AND hour(timestamp) = 18"
)
def friday_evening(t):
    return clean.on_weekday_hour(t.hourly(), 4, 18).select("timestamp", "grid_id", "total_activity")


@query(
    f"WITH {SHIPMENTS_SQL} SELECT grid_id, count(*) AS rows FROM shipments WHERE grid_id BETWEEN 1 AND 10000 "
    "GROUP BY grid_id"
)
def cells_in_domain(t):
    return clean.in_domain(t.shipments()).groupBy("grid_id").agg(F.count(F.lit(1)).alias("rows"))


@query(
    f"{with_hourly()} SELECT grid_id, timestamp, total_activity FROM hourly "
    "WHERE date IN (DATE '2024-01-05', DATE '2024-01-06')"
)
def rows_of_dates(t):
    chosen = clean.on_dates(t.hourly(), ("2024-01-05", "2024-01-06"))
    return chosen.select("grid_id", "timestamp", "total_activity")


@query(f"WITH {usage_sql()} SELECT DISTINCT country_code FROM usage")
def distinct_countries(t):
    return t.usage().select("country_code").distinct()


@query(f"WITH {usage_sql()} SELECT grid_id, min(timestamp) AS timestamp FROM usage GROUP BY grid_id")
def first_row_per_cell(t):
    """One row per cell, the earliest one, as a deterministic drop of duplicate keys."""
    return t.usage().groupBy("grid_id").agg(F.min("timestamp").alias("timestamp"))


@query(
    f"WITH {usage_sql()} SELECT DISTINCT timestamp, grid_id, {', '.join(MEASURES)} FROM usage"
)
def exact_duplicates_dropped(t):
    return t.usage().select("timestamp", "grid_id", *MEASURES).dropDuplicates()


@query(
    f"WITH {usage_sql()} "
    + " UNION ALL ".join(
        f"SELECT timestamp, grid_id, '{name}' AS measure, {name} AS amount FROM usage WHERE {name} IS NOT NULL"
        for name in MEASURE_EVENTS
    )
)
def stacked_measures(t):
    """One frame per measure stacked into a single table."""
    usage = t.usage()
    frames = [
        usage.where(F.col(name).isNotNull()).select(
            "timestamp", "grid_id", F.lit(name).alias("measure"), F.col(name).alias("amount")
        )
        for name in MEASURE_EVENTS
    ]
    return hourly.union_days(*frames)


@query(
    "SELECT event_id, ROUND(sin(2 * pi() * hour(ts) / 24.0), 6) AS hour_sin, "
    "ROUND(cos(2 * pi() * hour(ts) / 24.0), 6) AS hour_cos, ROUND(sin(2 * pi() * (isodow(ts) - 1) / 7.0), 6) "
    "AS dow_sin, ROUND(cos(2 * pi() * (isodow(ts) - 1) / 7.0), 6) AS dow_cos FROM events"
)
def cyclic_clock(t):
    ts = F.col("ts").cast("timestamp")
    return rounded(
        t.read("events").select(
            "event_id",
            cycle_sin(F.hour(ts), 24).alias("hour_sin"),
            cycle_cos(F.hour(ts), 24).alias("hour_cos"),
            cycle_sin(F.weekday(ts), 7).alias("dow_sin"),
            cycle_cos(F.weekday(ts), 7).alias("dow_cos"),
        ),
        6,
    )


@query(
    f"SELECT user_id + 1 AS grid_id, CAST(user_id % {WIDTH} AS INTEGER) AS x, CAST(user_id // {WIDTH} AS INTEGER) AS y, "
    "user_id + 1 AS back FROM events"
)
def lattice_places(t):
    cell = F.col("user_id") + 1
    x, y = lattice_x(cell, WIDTH), lattice_y(cell, WIDTH)
    return t.read("events").select(
        cell.alias("grid_id"), x.alias("x"), y.alias("y"), lattice_id(x, y, WIDTH).alias("back")
    )


@query(
    "SELECT event_id, ROUND(ln(1 + value), 6) AS log_value, ROUND(exp(ln(1 + value)) - 1, 4) AS value_back, "
    "CAST(date_trunc('day', ts) AS TIMESTAMP) + to_hours(CAST(hour(ts) AS INTEGER)) AS hour_start FROM events"
)
def log_scale_and_hour_start(t):
    ts = F.col("ts").cast("timestamp")
    log = F.log1p("value")
    return t.read("events").select(
        "event_id",
        F.round(log, 6).alias("log_value"),
        F.round(F.greatest(F.expm1(log), F.lit(0.0)), 4).alias("value_back"),
        day_and_hour(F.to_date(ts), F.hour(ts)).alias("hour_start"),
    )


@query(
    "SELECT o_orderkey, CASE WHEN lower(o_orderpriority) LIKE '%crit%' OR lower(o_orderpriority) LIKE '%high%' "
    "THEN 'critical' WHEN lower(o_orderpriority) LIKE '%warn%' OR lower(o_orderpriority) LIKE '%elev%' "
    "OR lower(o_orderpriority) LIKE '%med%' THEN 'warn' ELSE 'ok' END AS severity FROM orders"
)
def order_severity(t):
    return t.read("orders").select("o_orderkey", severity("o_orderpriority").alias("severity"))
