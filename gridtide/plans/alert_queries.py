"""Queries over the rule-based detector. Cells are the zones, whose days are mostly complete."""

from pyspark.sql import functions as F

from gridtide.operators import alerts, quality
from gridtide.plans.binding import SCALE, rounded, with_hourly
from gridtide.plans.catalog import query

_ZONES = with_hourly("zone")

BASELINE_SQL = (
    "complete AS (SELECT grid_id, date FROM hourly GROUP BY 1, 2 HAVING count(DISTINCT hour) = 24), "
    "baselines AS (SELECT a.grid_id, a.timestamp, median(b.total_activity) AS baseline_activity FROM hourly a "
    "JOIN complete c ON a.grid_id = c.grid_id AND a.date = c.date JOIN hourly b ON a.grid_id = b.grid_id "
    "AND a.date = b.date AND a.hour <> b.hour GROUP BY 1, 2)"
)
FLOOR_SQL = (
    "days AS (SELECT grid_id, date, ROUND(sum(total_activity), 2) AS day_total FROM hourly GROUP BY 1, 2), "
    "floors AS (SELECT quantile_cont(day_total, 0.05) AS floor_value FROM days)"
)
SCORED_SQL = (
    f"{BASELINE_SQL}, {FLOOR_SQL}, ordered AS (SELECT h.*, lag(total_activity) OVER (PARTITION BY grid_id, date "
    "ORDER BY hour) AS previous FROM hourly h), scored AS (SELECT o.grid_id, o.timestamp, o.total_activity, "
    "b.baseline_activity, o.previous, d.day_total < f.floor_value AS below_floor, f.floor_value / 24 AS hourly_floor "
    "FROM ordered o LEFT JOIN baselines b USING (grid_id, timestamp) JOIN days d ON o.grid_id = d.grid_id "
    "AND o.date = d.date CROSS JOIN floors f), flagged AS (SELECT *, "
    "coalesce(NOT below_floor AND total_activity >= 2 * baseline_activity, false) AS high_activity_flag, "
    "coalesce(NOT below_floor AND total_activity <= 0.5::DOUBLE * baseline_activity, false) AS drop_flag, "
    "coalesce(NOT below_floor AND previous > hourly_floor AND total_activity >= 3 * previous, false) AS spike_flag "
    "FROM scored)"
)
ALERTS_SQL = (
    f"{SCORED_SQL}, alerts AS (SELECT grid_id, timestamp, 'HIGH_ACTIVITY' AS alert_type, total_activity AS "
    "current_activity, baseline_activity FROM flagged WHERE high_activity_flag UNION ALL SELECT grid_id, timestamp, "
    "'ACTIVITY_DROP', total_activity, baseline_activity FROM flagged WHERE drop_flag UNION ALL SELECT grid_id, "
    "timestamp, 'ACTIVITY_SPIKE', total_activity, baseline_activity FROM flagged WHERE spike_flag)"
)
ALERTS = f"{_ZONES}, {ALERTS_SQL}"


def zone_hourly(t):
    return t.hourly("zone")


def zone_alerts(t):
    return alerts.detect_alerts(zone_hourly(t), scale=SCALE)


@query(
    f"{_ZONES}, {BASELINE_SQL} SELECT h.grid_id, h.timestamp, h.total_activity, ROUND(baseline_activity, 6) AS "
    "baseline_activity FROM hourly h LEFT JOIN baselines USING (grid_id, timestamp)"
)
def leave_one_out_baseline(t):
    based = alerts.with_baseline(zone_hourly(t))
    return based.select("grid_id", "timestamp", "total_activity", F.round("baseline_activity", 6).alias("baseline_activity"))


@query(
    f"{_ZONES} SELECT grid_id, date, count(DISTINCT hour) AS distinct_hours, count(*) AS rows FROM hourly "
    "GROUP BY 1, 2 HAVING count(DISTINCT hour) <> 24"
)
def partial_days(t):
    return quality.partial_days(zone_hourly(t))


@query(
    f"{_ZONES} SELECT grid_id, timestamp FROM hourly WHERE (grid_id, date) IN (SELECT (grid_id, date) FROM hourly "
    "GROUP BY grid_id, date HAVING count(DISTINCT hour) <> 24)"
)
def rows_in_partial_days(t):
    return quality.rows_in_partial_days(zone_hourly(t)).select("grid_id", "timestamp")


@query(
    f"{_ZONES} SELECT grid_id, timestamp FROM hourly WHERE (grid_id, date) IN (SELECT (grid_id, date) FROM hourly "
    "GROUP BY grid_id, date HAVING count(DISTINCT hour) = 24)"
)
def rows_in_full_days(t):
    return quality.rows_in_full_days(zone_hourly(t)).select("grid_id", "timestamp")


@query(
    f"{_ZONES}, {FLOOR_SQL} SELECT ROUND(floor_value, 6) AS floor_value, ROUND(floor_value / 24, 6) AS "
    "hourly_floor_value FROM floors"
)
def activity_floor(t):
    return rounded(alerts.activity_floor(zone_hourly(t), scale=SCALE), 6)


@query(
    f"{_ZONES} SELECT grid_id, timestamp, lag(total_activity) OVER (PARTITION BY grid_id, date ORDER BY hour) "
    "AS previous_hour_activity FROM hourly"
)
def previous_hour(t):
    return alerts.with_previous_hour(zone_hourly(t)).select("grid_id", "timestamp", "previous_hour_activity")


@query(
    f"{_ZONES}, p AS (SELECT *, lag(total_activity) OVER w AS v, lag(hour) OVER w AS h FROM hourly WINDOW w AS "
    "(PARTITION BY grid_id, date ORDER BY hour)) SELECT grid_id, timestamp, CASE WHEN h = hour - 1 THEN v END "
    "AS previous_hour_activity FROM p"
)
def previous_hour_strict(t):
    strict = alerts.with_previous_hour(zone_hourly(t), strict_hours=True)
    return strict.select("grid_id", "timestamp", "previous_hour_activity")


@query(f"{_ZONES}, {SCORED_SQL} SELECT grid_id, timestamp, below_floor, high_activity_flag, drop_flag, spike_flag FROM flagged")
def rule_flags(t):
    scored = alerts.score_rules(zone_hourly(t), scale=SCALE)
    return scored.select("grid_id", "timestamp", "below_floor", "high_activity_flag", "drop_flag", "spike_flag")


@query(
    f"{ALERTS} SELECT grid_id, timestamp, alert_type, ROUND(current_activity, 6) AS current_activity, ROUND(baseline_activity, 6) AS "
    "baseline_activity FROM alerts"
)
def rule_alerts(t):
    return rounded(zone_alerts(t).drop("reason"), 6)


@query(f"{ALERTS} SELECT alert_type, count(*) AS alerts FROM alerts GROUP BY alert_type")
def alerts_by_type(t):
    return alerts.alerts_by_type(zone_alerts(t))


@query(
    f"{ALERTS} SELECT grid_id, count(*) AS alert_count FROM alerts GROUP BY grid_id ORDER BY 2 DESC, 1 LIMIT 10"
)
def cells_by_alerts(t):
    return alerts.cells_by_alerts(zone_alerts(t))


@query(
    f"{ALERTS} SELECT (SELECT count(*) FROM alerts) AS total_alert_records, (SELECT count(*) FROM (SELECT DISTINCT "
    "grid_id, timestamp FROM alerts)) AS alerted_grid_hours, (SELECT count(*) FROM hourly) AS total_grid_hours, "
    "ROUND((SELECT count(*) FROM (SELECT DISTINCT grid_id, timestamp FROM alerts)) / (SELECT count(*) FROM hourly), 6) "
    "AS alerted_proportion"
)
def alerted_share(t):
    return rounded(alerts.alerted_share_of(alerts.score_rules(zone_hourly(t), scale=SCALE)), 6)
