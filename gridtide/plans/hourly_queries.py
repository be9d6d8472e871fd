"""Queries over the hourly table and its aggregates."""

from pyspark.sql import functions as F

from gridtide.operators import clean, hourly
from gridtide.plans.binding import (
    CLEAN_SQL,
    fixed_sum_sql,
    rounded,
    usage_sql,
    with_hourly,
    with_shipments_hourly,
)
from gridtide.plans.catalog import query
from gridtide.schemas import HOURLY_COLUMNS, HOURLY_MEASURES, MEASURES

_KPIS = ", ".join(
    f"ROUND(sum({name}), 4) AS {name}" for name in ("total_sms", "total_calls", "internet_activity", "total_activity")
)


@query(
    f"{with_hourly()} SELECT h.*, ROUND(sum(total_activity) OVER (PARTITION BY grid_id, date), 4) AS daily_activity, "
    "ROUND(CASE WHEN total_activity = 0 THEN 0 ELSE internet_activity / total_activity END, 6) AS internet_share "
    "FROM hourly h"
)
def hourly_summary(t):
    summary = hourly.hourly_summary(t.clean(), scale=2)
    return summary.withColumns(
        {"daily_activity": F.round("daily_activity", 4), "internet_share": F.round("internet_share", 6)}
    )


@query(f"{with_hourly()} SELECT {', '.join(HOURLY_COLUMNS)} FROM hourly")
def hourly_by_calendar(t):
    return hourly.hourly_by_calendar(t.clean(), scale=2)


@query(
    f"WITH {usage_sql()}, {CLEAN_SQL}, s AS (SELECT date, hour, grid_id, "
    + ", ".join(
        f"{fixed_sum_sql(name)} AS {'internet_activity' if name == 'internet' else name}" for name in MEASURES
    )
    + ", count(timestamp) AS record_count FROM clean GROUP BY 1, 2, 3) SELECT *, "
    + " + ".join(HOURLY_MEASURES)
    + " AS total_activity FROM s"
)
def hourly_by_slot(t):
    loose = t.clean().withColumnRenamed("internet", "internet_usage").drop("date", "hour")
    return hourly.hourly_by_slot(loose, scale=2)


@query(
    f"{with_hourly()} SELECT grid_id, timestamp, sms_in, sms_out, call_in, call_out, internet_activity AS internet, "
    "total_sms, total_calls, total_activity, date, hour, CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week FROM hourly"
)
def hourly_batch(t):
    return hourly.hourly_batch(t.clean(), scale=2)


@query(
    f"{with_shipments_hourly()} SELECT grid_id, ROUND(sum(total_activity), 4) AS window_total_activity FROM hourly "
    "GROUP BY grid_id ORDER BY 2 DESC, 1 LIMIT 10"
)
def top_cells_by_shipments(t):
    return rounded(hourly.top_cells(t.shipments_hourly()))


@query(
    f"{with_hourly()} SELECT grid_id, ROUND(sum(total_activity), 4) AS window_total_activity FROM hourly "
    "WHERE timestamp >= TIMESTAMP '2024-01-08 00:00:00' AND timestamp <= TIMESTAMP '2024-01-21 23:00:00' "
    "GROUP BY grid_id ORDER BY 2 DESC, 1 LIMIT 10"
)
def top_cells(t):
    window = clean.between_times(t.hourly(), "2024-01-08 00:00:00", "2024-01-21 23:00:00")
    return rounded(hourly.top_cells(window))


@query(
    f"{with_hourly()} SELECT timestamp, hour, ROUND(sum(total_activity), 4) AS total_activity FROM hourly "
    "GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 1"
)
def peak_timestamp(t):
    return rounded(hourly.peak_timestamp(t.hourly()))


@query(f"{with_hourly()} SELECT date, {_KPIS} FROM hourly GROUP BY date")
def daily_kpis(t):
    return rounded(hourly.daily_kpis(t.hourly()))


@query(f"{with_hourly()} SELECT grid_id, {_KPIS} FROM hourly GROUP BY grid_id")
def cell_kpis(t):
    return rounded(hourly.cell_kpis(t.hourly()))


@query(f"{with_shipments_hourly()} SELECT date, {_KPIS} FROM hourly GROUP BY date")
def daily_kpis_by_shipments(t):
    return rounded(hourly.daily_kpis(t.shipments_hourly()))


def _busiest_sql(key):
    return (
        f"{with_hourly()} SELECT {key} AS busiest_{key}, ROUND(sum(total_activity), 4) AS "
        f"busiest_{key}_total_activity FROM hourly GROUP BY {key} ORDER BY 2 DESC, 1 LIMIT 1"
    )


@query(_busiest_sql("hour"))
def busiest_hour(t):
    return rounded(hourly.busiest(t.hourly(), "hour"))


@query(_busiest_sql("grid_id"))
def busiest_cell(t):
    return rounded(hourly.busiest(t.hourly(), "grid_id"))


@query(
    f"WITH {usage_sql()}, {CLEAN_SQL} SELECT hour, grid_id, count(DISTINCT country_code) AS country_codes FROM clean "
    "GROUP BY 1, 2"
)
def countries_per_cell_hour(t):
    return hourly.countries_per_cell_hour(t.clean())


@query(
    f"{with_hourly()} SELECT hour, day_of_week, "
    + ", ".join(
        f"count(DISTINCT {name}) AS {name}" for name in HOURLY_COLUMNS if name not in ("hour", "day_of_week")
    )
    + " FROM hourly GROUP BY hour, day_of_week"
)
def distinct_values_per_slot(t):
    return hourly.distinct_values(t.hourly().select(*HOURLY_COLUMNS), ("hour", "day_of_week"))


@query(f"WITH {usage_sql()}, {CLEAN_SQL} SELECT date, count(*) AS rows FROM clean GROUP BY date")
def rows_per_date(t):
    return hourly.rows_per_date(t.clean())
