"""Queries over the serving lookups."""

from pyspark.sql import functions as F

from gridtide.operators import features, serving, warehouse
from gridtide.plans.alert_queries import ALERTS, zone_alerts
from gridtide.plans.binding import CELLS_SQL, WIDTH, rounded, with_hourly
from gridtide.plans.catalog import query
from gridtide.plans.warehouse_queries import DAY_SUMMARY_SQL

_HOURLY = with_hourly()
_DAILY = "grid_daily AS (SELECT grid_id, date AS day, sum(total_activity) AS total_activity FROM hourly GROUP BY 1, 2)"
_AVG = "ROUND(avg(total_activity), 6) AS avg_activity"


def _timed(t):
    return serving.timed_fact(t.fact(), t.times())


def _daily(t):
    return warehouse.grid_daily_summary(t.hourly())


@query(f"{_HOURLY}, {DAY_SUMMARY_SQL} SELECT * FROM day_summary WHERE summary_date = DATE '2024-01-15'")
def summary_of_date(t):
    return rounded(serving.network_summary(warehouse.day_summary(t.hourly()), "2024-01-15"))


@query(f"{_HOURLY} SELECT hour, {_AVG} FROM hourly GROUP BY hour")
def hourly_profile(t):
    return rounded(serving.hourly_profile(_timed(t)), 6)


@query(f"{_HOURLY} SELECT hour, {_AVG} FROM hourly WHERE date = DATE '2024-01-15' GROUP BY hour")
def hourly_profile_of_date(t):
    return rounded(serving.hourly_profile(_timed(t), "2024-01-15"), 6)


@query(f"{_HOURLY} SELECT hour AS peak_hour FROM hourly GROUP BY hour ORDER BY ROUND(avg(total_activity), 6) DESC, hour LIMIT 1")
def profile_peak(t):
    return serving.profile_peak(serving.hourly_profile(t.hourly()))


@query(f"{_HOURLY} SELECT day_of_week, dayname(timestamp) AS label, {_AVG} FROM hourly GROUP BY 1, 2")
def weekday_profile(t):
    return rounded(serving.weekday_profile(_timed(t)), 6)


@query(
    f"{_HOURLY} SELECT date AS summary_date, ROUND(sum(total_calls), 4) AS voice_activity, ROUND(sum(total_sms), 4) AS "
    "sms_activity, ROUND(sum(internet_activity), 4) AS internet_activity FROM hourly WHERE date > (SELECT max(date) "
    "FROM hourly) - 14 GROUP BY date"
)
def traffic_mix(t):
    return rounded(serving.traffic_mix(t.hourly(), days=14))


_ALL_CELLS = (
    f"{_HOURLY}, {CELLS_SQL}, {_DAILY}, activity AS (SELECT grid_id, sum(total_activity) AS activity FROM grid_daily "
    "GROUP BY grid_id), located AS (SELECT c.grid_id, centroid_latitude, centroid_longitude, ROUND(coalesce(activity, 0), 4) AS "
    "activity FROM cells c LEFT JOIN activity USING (grid_id))"
)


@query(
    f"{_ALL_CELLS} SELECT grid_id, ROUND(centroid_latitude, 4) AS centroid_latitude, ROUND(centroid_longitude, 4) AS "
    "centroid_longitude, ROUND(activity, 4) AS activity FROM located"
)
def all_cells(t):
    return rounded(serving.all_cells(t.cells(), _daily(t)))


@query(
    f"{_HOURLY}, {CELLS_SQL}, {_DAILY} SELECT c.grid_id, ROUND(centroid_latitude, 4) AS centroid_latitude, "
    "ROUND(centroid_longitude, 4) AS centroid_longitude, ROUND(coalesce(total_activity, 0), 4) AS activity FROM cells c "
    "LEFT JOIN (SELECT * FROM grid_daily WHERE day = DATE '2024-01-15') g USING (grid_id)"
)
def all_cells_of_date(t):
    return rounded(serving.all_cells(t.cells(), _daily(t), "2024-01-15"))


@query(
    f"{_ALL_CELLS}, relative AS (SELECT grid_id, activity / greatest((SELECT max(activity) FROM located), 1) AS r FROM "
    "located) SELECT grid_id, ROUND(r, 6) AS relative, CASE WHEN r >= 0.75 THEN 'critical' WHEN r >= 0.5 THEN 'high' "
    "WHEN r >= 0.22 THEN 'mid' ELSE 'low' END AS heat FROM relative"
)
def heat_map(t):
    heated = serving.heat_map(rounded(serving.all_cells(t.cells(), _daily(t))))
    return rounded(heated.select("grid_id", "relative", "heat"), 6)


@query(
    f"{_HOURLY}, {CELLS_SQL}, {_DAILY} SELECT grid_id, ROUND(total_activity, 4) AS activity, ROUND(centroid_latitude, 4) "
    "AS centroid_lat, ROUND(centroid_longitude, 4) AS centroid_lon FROM grid_daily JOIN cells USING (grid_id) WHERE day "
    "= (SELECT max(day) FROM grid_daily) ORDER BY ROUND(total_activity, 4) DESC, grid_id LIMIT 10"
)
def top_cells_of_latest_date(t):
    return rounded(serving.top_cells_on(_daily(t), t.cells()))


_SERIES = "SELECT timestamp, total_activity, total_sms, total_calls, internet_activity FROM hourly WHERE grid_id = 2"


@query(
    f"{with_hourly('zone')} {_SERIES} AND timestamp BETWEEN (SELECT max(timestamp) FROM hourly) - INTERVAL 23 HOURS "
    "AND (SELECT max(timestamp) FROM hourly)"
)
def cell_series_latest(t):
    return serving.cell_series(t.fact("zone"), t.times("zone"), 2)


@query(
    f"{with_hourly('zone')} {_SERIES} AND timestamp BETWEEN TIMESTAMP '2024-01-15 06:00:00' - INTERVAL 23 HOURS AND "
    "TIMESTAMP '2024-01-15 06:00:00' AND date = DATE '2024-01-14' AND hour = 20"
)
def cell_series_of_hour(t):
    return serving.cell_series(
        t.fact("zone"), t.times("zone"), 2, date="2024-01-14", hour=20, as_of="2024-01-15 06:00:00"
    )


def _latest_sql(end):
    return (
        f"(SELECT total_activity FROM hourly WHERE grid_id = 1 AND timestamp BETWEEN {end} - INTERVAL 23 HOURS AND {end} "
        "ORDER BY timestamp DESC LIMIT 1)"
    )


_NOW = "TIMESTAMP '2024-01-15 06:00:00'"


@query(
    f"{with_hourly('zone')} SELECT {_latest_sql(_NOW)} AS current_activity, "
    f"{_latest_sql(f'({_NOW} + INTERVAL 1 HOUR)')} AS next_activity"
)
def current_and_next(t):
    return serving.current_and_next(t.hourly("zone"), 1, "2024-01-15 06:00:00")


@query(
    f"{_HOURLY}, {DAY_SUMMARY_SQL}, d AS (SELECT summary_date, total_activity, active_grids, (total_activity - "
    "lag(total_activity) OVER w) / lag(total_activity) OVER w * 100 AS a, (active_grids - lag(active_grids) OVER w) / "
    "lag(active_grids) OVER w * 100 AS g FROM day_summary WINDOW w AS (ORDER BY summary_date)) SELECT summary_date, "
    "total_activity, active_grids, ROUND(a, 6) AS total_activity_pct, ROUND(g, 6) AS active_grids_pct, CASE WHEN a > 0.5 "
    "THEN 'up' WHEN a < -0.5 THEN 'down' WHEN a IS NOT NULL THEN 'flat' END AS total_activity_trend, CASE WHEN g > 0.5 "
    "THEN 'up' WHEN g < -0.5 THEN 'down' WHEN g IS NOT NULL THEN 'flat' END AS active_grids_trend FROM d"
)
def day_over_day(t):
    return rounded(serving.day_over_day(rounded(warehouse.day_summary(t.hourly()))), 6)


_ALERT_COLUMNS = "grid_id, timestamp, alert_type, ROUND(current_activity, 6) AS current_activity, ROUND(baseline_activity, 6) AS baseline_activity"


@query(f"{ALERTS} SELECT {_ALERT_COLUMNS} FROM alerts ORDER BY timestamp DESC, grid_id, alert_type LIMIT 20")
def latest_alerts(t):
    return rounded(serving.latest_alerts(zone_alerts(t)).drop("reason"), 6)


@query(
    f"{ALERTS} SELECT {_ALERT_COLUMNS} FROM alerts WHERE alert_type = 'HIGH_ACTIVITY' AND timestamp <= TIMESTAMP "
    "'2024-01-20 00:00:00' ORDER BY current_activity DESC, timestamp DESC, grid_id LIMIT 20"
)
def hotspots(t):
    return rounded(serving.hotspots(zone_alerts(t), as_of="2024-01-20 00:00:00").drop("reason"), 6)


@query(
    f"{ALERTS} SELECT CAST(timestamp AS DATE) AS date, count(*) FILTER (WHERE alert_type = 'HIGH_ACTIVITY') AS critical, "
    "count(*) FILTER (WHERE alert_type IN ('ACTIVITY_DROP', 'ACTIVITY_SPIKE')) AS warn FROM alerts WHERE timestamp >= "
    "(SELECT CAST(max(timestamp) AS DATE) - 6 FROM alerts) GROUP BY 1"
)
def alert_timeline(t):
    return serving.alert_timeline(zone_alerts(t), days=7)


def zone_features(t):
    return features.drop_features(t.hourly("zone"), WIDTH)


_FEATURES = (
    f"{with_hourly('zone')}, features AS (SELECT grid_id, timestamp, lag(total_activity, 24) OVER w AS activity_lag_24, "
    "(SELECT avg(o.total_activity) FROM hourly o WHERE o.timestamp = h.timestamp AND abs(o.grid_id - h.grid_id) = 1) AS "
    "neighbor_avg_activity, row_number() OVER w AS position FROM hourly h WINDOW w AS (PARTITION BY grid_id ORDER BY "
    "timestamp))"
)


@query(
    f"{_FEATURES} SELECT grid_id, timestamp, CASE WHEN position <= 24 OR neighbor_avg_activity IS NULL THEN 'INVALID' "
    "ELSE 'OK' END AS quality_status FROM features"
)
def feature_quality(t):
    """OK or INVALID per feature row; zone series lack features only at their head or without neighbours."""
    return serving.missing_features(zone_features(t)).select("grid_id", "timestamp", "quality_status")


@query(
    f"{with_hourly('zone')}, aged AS (SELECT grid_id, timestamp, greatest(date_diff('microsecond', timestamp, TIMESTAMP "
    "'2024-01-15 06:00:00') / 3600000000.0, 0) AS age FROM hourly) SELECT "
    "grid_id, timestamp, ROUND(age, 2) AS age_hours, CASE WHEN age <= 2 THEN 'FRESH' WHEN age <= 6 THEN 'STALE' ELSE "
    "'OUTDATED' END AS freshness_status FROM aged"
)
def feature_freshness(t):
    now = F.lit("2024-01-15 06:00:00").cast("timestamp")
    return serving.with_freshness(t.hourly("zone").select("grid_id", "timestamp"), now)


@query(
    f"{_FEATURES} SELECT grid_id, timestamp, ROUND(activity_lag_24, 6) AS activity_lag_24, ROUND(neighbor_avg_activity, "
    "6) AS neighbor_avg_activity, age AS age_hours, CASE WHEN age <= 2 THEN 'FRESH' WHEN age <= 6 THEN 'STALE' ELSE "
    "'OUTDATED' END AS freshness_status FROM (SELECT *, CAST(date_diff('hour', timestamp, (SELECT max(timestamp) FROM "
    "hourly)) AS DOUBLE) AS age FROM features) WHERE grid_id = 2 AND timestamp = (SELECT max(timestamp) FROM hourly WHERE "
    "grid_id = 2)"
)
def cell_features_latest(t):
    row = serving.cell_features(zone_features(t), 2)
    return rounded(
        row.select(
            "grid_id", "timestamp", "activity_lag_24", "neighbor_avg_activity", "age_hours", "freshness_status"
        ),
        6,
    )


@query(
    f"{ALERTS} SELECT (SELECT max(timestamp) FROM hourly) AS latest_raw_activity, (SELECT max(timestamp) FROM hourly) AS "
    "latest_features_computed, (SELECT max(timestamp) FROM alerts) AS latest_rule_alerts, 'HEALTHY' AS pipeline_status, "
    "true AS is_synchronized, 'Features and alerts are synchronized with raw activity.' AS freshness_assessment"
)
def pipeline_health(t):
    layers = {"activity": t.hourly("zone"), "features": zone_features(t), "alerts": zone_alerts(t)}
    activity, features, alerts = (serving.layer_mark(name, table) for name, table in layers.items())
    return serving.pipeline_health(activity.unionByName(features).unionByName(alerts))


@query(
    f"{_HOURLY}, {CELLS_SQL}, seen AS (SELECT grid_id, max(timestamp) AS latest_feature_timestamp, count(*) AS n FROM "
    "hourly GROUP BY grid_id) SELECT grid_id, latest_feature_timestamp, coalesce(n, 0) AS feature_records, CASE WHEN "
    "latest_feature_timestamp IS NULL THEN 'NO_DATA' ELSE 'VALID' END AS status FROM cells LEFT JOIN seen USING (grid_id)"
)
def feature_coverage(t):
    return serving.feature_coverage(t.cells(), t.hourly())


@query("SELECT 'events' AS table_name, count(*) AS rows FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def stored_table_counts(t):
    counts = serving.table_row_count(t.read("events"), "events")
    return counts.unionByName(serving.table_row_count(t.read("lineitem"), "lineitem"))
