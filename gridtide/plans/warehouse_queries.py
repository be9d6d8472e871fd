"""Queries over the star schema, the daily marts and the geometry joins."""

from pyspark.sql import functions as F

from gridtide.operators import enrich, warehouse
from gridtide.plans.binding import (
    CELLS_SQL,
    FACT_SQL,
    GEOMETRY_SQL,
    TIMES_SQL,
    rounded,
    with_hourly,
    with_shipments_hourly,
)
from gridtide.plans.catalog import query
from gridtide.schemas import ENRICHED_COLUMNS, FACT_COLUMNS


@query(f"WITH {CELLS_SQL} SELECT grid_id, ROUND(centroid_latitude, 6) AS centroid_latitude, "
       "ROUND(centroid_longitude, 6) AS centroid_longitude FROM cells")  # fmt: skip
def dim_grid(t):
    return rounded(warehouse.dim_grid(t.cells()), 6)


@query(f"{with_hourly()}, {TIMES_SQL} SELECT * FROM times")
def dim_time(t):
    return t.times()


@query(f"{with_hourly()}, {TIMES_SQL}, {FACT_SQL} SELECT * FROM fact")
def fact_activity(t):
    return t.fact()


@query(
    f"{with_hourly()}, {TIMES_SQL}, {FACT_SQL} SELECT "
    + ", ".join(f"f.{name}" for name in FACT_COLUMNS)
    + ", t.date, t.hour FROM fact f JOIN times t USING (time_key)"
)
def fact_with_time(t):
    return warehouse.fact_with_time(t.fact(), t.times())


@query(
    f"{with_hourly()} SELECT date, ROUND(sum(total_activity), 4) AS total_activity, "
    "count(DISTINCT grid_id) AS active_grids FROM hourly GROUP BY date"
)
def daily_metrics(t):
    return rounded(warehouse.daily_metrics(t.hourly()))


def _peak_sql(key, name):
    return (
        f"{with_hourly()}, s AS (SELECT date, {key}, sum(total_activity) AS a FROM hourly GROUP BY 1, 2) "
        f"SELECT date, {key} AS {name} FROM s QUALIFY row_number() OVER (PARTITION BY date ORDER BY ROUND(a, 4) DESC, "
        f"{key}) = 1"
    )


@query(_peak_sql("hour", "peak_hour"))
def peak_hour_per_date(t):
    return warehouse.peak_per_date(t.hourly(), "hour", "peak_hour")


@query(_peak_sql("grid_id", "top_grid"))
def top_cell_per_date(t):
    return warehouse.peak_per_date(t.hourly(), "grid_id", "top_grid")


DAY_SUMMARY_SQL = (
    "by_hour AS (SELECT date, hour, sum(total_activity) AS a FROM hourly GROUP BY 1, 2), "
    "by_cell AS (SELECT date, grid_id, sum(total_activity) AS a FROM hourly GROUP BY 1, 2), "
    "day_summary AS (SELECT d.date AS summary_date, ROUND(d.total_activity, 4) AS total_activity, d.active_grids, "
    "(SELECT hour FROM by_hour x WHERE x.date = d.date ORDER BY ROUND(a, 4) DESC, hour LIMIT 1) AS peak_hour, "
    "(SELECT grid_id FROM by_cell x WHERE x.date = d.date ORDER BY ROUND(a, 4) DESC, grid_id LIMIT 1) AS top_grid "
    "FROM (SELECT date, sum(total_activity) AS total_activity, count(DISTINCT grid_id) AS active_grids FROM hourly "
    "GROUP BY date) d)"
)


@query(f"{with_hourly()}, {DAY_SUMMARY_SQL} SELECT * FROM day_summary")
def day_summary(t):
    return rounded(warehouse.day_summary(t.hourly()))


@query(f"{with_shipments_hourly()}, {DAY_SUMMARY_SQL} SELECT * FROM day_summary")
def day_summary_by_shipments(t):
    return rounded(warehouse.day_summary(t.shipments_hourly()))


@query(
    f"{with_hourly()} SELECT grid_id, date AS day, ROUND(sum(total_activity), 4) AS total_activity FROM hourly "
    "GROUP BY 1, 2"
)
def grid_daily_summary(t):
    return rounded(warehouse.grid_daily_summary(t.hourly()))


_ENRICHED = ", ".join(name if name == "geometry" else f"h.{name}" for name in ENRICHED_COLUMNS)
_WITH_GEOMETRY = f"{with_hourly()}, {GEOMETRY_SQL} SELECT {_ENRICHED} FROM hourly h LEFT JOIN geometry g USING (grid_id)"


@query(_WITH_GEOMETRY)
def with_geometry(t):
    return enrich.enriched_columns(enrich.with_geometry(t.hourly(), t.geometry()))


@query(_WITH_GEOMETRY)
def with_geometry_shuffled(t):
    return enrich.enriched_columns(enrich.with_geometry_shuffled(t.hourly(), t.geometry()))


@query(
    f"{with_hourly()}, {GEOMETRY_SQL}, top AS (SELECT grid_id, ROUND(sum(total_activity), 4) AS window_total_activity "
    "FROM hourly GROUP BY grid_id ORDER BY 2 DESC, 1 LIMIT 10) SELECT grid_id, window_total_activity, geometry "
    "FROM top LEFT JOIN geometry USING (grid_id)"
)
def top_cells_with_geometry(t):
    return rounded(enrich.top_cells_with_geometry(t.hourly(), t.geometry()))


@query(
    f"{with_hourly()}, {GEOMETRY_SQL}, slice AS (SELECT * FROM hourly JOIN geometry USING (grid_id) "
    "WHERE isodow(timestamp) = 5 AND hour(timestamp) = 18), cut AS (SELECT quantile_cont(total_activity, 0.98) AS c "
    "FROM slice) SELECT grid_id, timestamp, geometry, ROUND(total_activity, 4) AS total_activity, ROUND(c, 4) AS cutoff, "
    "ROUND(least(total_activity, c), 4) AS capped_activity FROM slice, cut"
)
def map_slice(t):
    sliced = enrich.map_slice(t.hourly(), t.geometry(), weekday=4, hour=18)
    return rounded(
        sliced.select("grid_id", "timestamp", "geometry", "total_activity", "cutoff", "capped_activity")
    )


@query(
    f"{with_hourly()}, known AS (SELECT c_custkey + 1 AS grid_id, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS "
    "cell_cluster FROM customer) SELECT h.grid_id, h.timestamp, coalesce(cell_cluster, -1) AS cell_cluster FROM hourly h "
    "LEFT JOIN known USING (grid_id)"
)
def cells_with_cluster(t):
    """Cluster label of every row, -1 for cells without one."""
    label = F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey"))
    labels = t.read("customer").select((F.col("c_custkey") + 1).alias("grid_id"), label.alias("cell_cluster"))
    return enrich.with_cluster(t.hourly().select("grid_id", "timestamp"), labels)
