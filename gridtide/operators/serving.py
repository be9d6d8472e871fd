"""Parameterised lookups over the warehouse, alert and feature tables.

The as-of and latest-date defaults are scalar subqueries, so a lookup is still one query.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide import texts
from gridtide.functions.columns import freshness, heat_class, hours_between, ratio_or_null, trend
from gridtide.operators.enrich import cells_with_activity, relative_activity
from gridtide.operators.warehouse import fact_with_time
from gridtide.schemas import DROP_FEATURES, MAX_GRID, MIN_GRID

LIMIT_MIN, LIMIT_MAX, LIMIT_DEFAULT = 1, 50, 10


def valid_grid(grid_id, low=MIN_GRID, high=MAX_GRID):
    """Return the id as an int or raise when it is not one or lies outside the domain."""
    try:
        number = int(grid_id)
    except (TypeError, ValueError):
        raise ValueError("grid_id must be an integer") from None
    if not low <= number <= high:
        raise ValueError(f"grid_id {number} is outside {low}..{high}")
    return number


def clamped_limit(limit, low=LIMIT_MIN, high=LIMIT_MAX, default=LIMIT_DEFAULT):
    """Clamp a row limit to its range; anything that is not a number gives the default."""
    try:
        return max(low, min(int(limit), high))
    except (TypeError, ValueError):
        return default


def _date(value):
    return F.lit(value).cast("date")


def _time(value):
    return F.lit(value).cast("timestamp")


def _as_of(table, as_of):
    return _time(as_of) if as_of is not None else table.agg(F.max("timestamp")).scalar()


def network_summary(day_summary, date=None):
    """Day summary of one date, or of all dates in order."""
    if date is not None:
        return day_summary.where(F.col("summary_date") == _date(date))
    return day_summary.orderBy("summary_date")


def hourly_profile(timed, date=None):
    """Average activity per hour of day."""
    if date is not None:
        timed = timed.where(F.col("date") == _date(date))
    return timed.groupBy("hour").agg(F.coalesce(F.avg("total_activity"), F.lit(0.0)).alias("avg_activity"))


def profile_peak(profile):
    """One row: the hour with the highest average; ties go to the earlier hour."""
    best = F.max(F.struct(F.col("avg_activity"), (-F.col("hour")).alias("h")))
    return profile.agg(best.alias("b")).select((-F.col("b.h")).alias("peak_hour"))


def weekday_profile(timed):
    """Average activity per day of week with its name."""
    return timed.groupBy("day_of_week", F.col("day_name").alias("label")).agg(
        F.coalesce(F.avg("total_activity"), F.lit(0.0)).alias("avg_activity")
    )


def traffic_mix(timed, days=14):
    """Voice, SMS and internet activity per date over the last `days` dates up to the latest one."""
    latest = timed.agg(F.max("date")).scalar()
    recent = timed.where((F.col("date") >= F.date_sub(latest, days - 1)) & (F.col("date") <= latest))
    return recent.groupBy(F.col("date").alias("summary_date")).agg(
        F.sum("total_calls").alias("voice_activity"),
        F.sum("total_sms").alias("sms_activity"),
        F.sum("internet_activity").alias("internet_activity"),
    )


def all_cells(cells, grid_daily, date=None):
    """Every cell with its activity on a date or in total, 0 where it had none."""
    if date is not None:
        activity = grid_daily.where(F.col("day") == _date(date)).select(
            "grid_id", F.col("total_activity").alias("activity")
        )
    else:
        activity = grid_daily.groupBy("grid_id").agg(F.sum("total_activity").alias("activity"))
    return cells_with_activity(cells, activity)


def heat_map(cells):
    """Cells with their activity relative to the busiest one and its heat band."""
    return relative_activity(cells).withColumn("heat", heat_class("relative"))


def top_cells_on(grid_daily, cells, date=None, n=10):
    """Busiest located cells of a date, by default the latest one; ties go to the lower id."""
    day = _date(date) if date is not None else grid_daily.agg(F.max("day")).scalar()
    located = grid_daily.where(F.col("day") == day).join(
        cells.select("grid_id", "centroid_latitude", "centroid_longitude"), "grid_id"
    )
    return (
        located.select(
            "grid_id",
            F.col("total_activity").alias("activity"),
            F.col("centroid_latitude").alias("centroid_lat"),
            F.col("centroid_longitude").alias("centroid_lon"),
        )
        .orderBy(F.desc("activity"), "grid_id")
        .limit(n)
    )


def cell_series(fact, times, grid_id, date=None, hour=None, as_of=None, low=MIN_GRID, high=MAX_GRID):
    """Series of one cell of the domain low..high over the 24 hours that end at `as_of`, by default the latest fact.

    Keys grow with time, so the latest fact is found by its key alone; the time filters reduce the
    time dimension before the join.
    """
    cell = valid_grid(grid_id, low, high)
    if as_of is None:
        last_key = fact.agg(F.max("time_key")).scalar()
        end = times.where(F.col("time_key") == last_key).agg(F.max("timestamp")).scalar()
    else:
        end = _time(as_of)
    window = times.where(
        (F.col("timestamp") >= end - F.expr("INTERVAL 23 HOURS")) & (F.col("timestamp") <= end)
    )
    if date is not None:
        window = window.where(F.col("date") == _date(date))
    if hour is not None:
        window = window.where(F.col("hour") == hour)
    series = fact.where(F.col("grid_id") == cell)
    # The window holds the distinct times of 24 hours at most.
    return series.join(F.broadcast(window.select("time_key", "timestamp")), "time_key").select(
        "timestamp", "total_activity", "total_sms", "total_calls", "internet_activity"
    )


def current_and_next(hourly, grid_id, as_of, low=MIN_GRID, high=MAX_GRID):
    """One row: activity of a cell at `as_of` and one hour later, each the latest point in its 24 h."""
    cell = hourly.where(F.col("grid_id") == valid_grid(grid_id, low, high))
    now = _time(as_of)
    later = now + F.expr("INTERVAL 1 HOUR")
    stamp = F.col("timestamp")

    def latest(end):
        inside = (stamp <= end) & (stamp >= end - F.expr("INTERVAL 23 HOURS"))
        return F.max_by(F.when(inside, F.col("total_activity")), F.when(inside, stamp))

    return cell.where((stamp >= now - F.expr("INTERVAL 23 HOURS")) & (stamp <= later)).agg(
        latest(now).alias("current_activity"), latest(later).alias("next_activity")
    )


def day_over_day(day_summary, columns=("total_activity", "active_grids")):
    """Percent change of daily KPIs against the previous summary row, with its direction."""
    order = Window.orderBy("summary_date")
    change = {}
    for name in columns:
        before = F.lag(name).over(order)
        change[f"{name}_pct"] = ratio_or_null(F.col(name) - before, before) * 100
    changed = day_summary.select("summary_date", *columns).withColumns(change)
    return changed.withColumns({f"{name}_trend": trend(f"{name}_pct") for name in columns})


def _upto(table, as_of):
    """Rows up to `as_of`; all rows without one, since none is later than the latest."""
    return table if as_of is None else table.where(F.col("timestamp") <= _time(as_of))


def latest_alerts(alerts, n=20, as_of=None):
    """Newest n alerts up to `as_of`, n between 1 and 50; ties by cell and type."""
    return _upto(alerts, as_of).orderBy(F.desc("timestamp"), "grid_id", "alert_type").limit(clamped_limit(n))


def hotspots(alerts, n=20, as_of=None):
    """High-activity alerts up to `as_of` with the largest activity, n between 1 and 50."""
    upto = _upto(alerts.where(F.col("alert_type") == "HIGH_ACTIVITY"), as_of)
    return upto.orderBy(F.desc("current_activity"), F.desc("timestamp"), "grid_id").limit(clamped_limit(n))


def alert_timeline(alerts, days=7):
    """Critical and warning alerts per date over the last `days` dates up to the latest alert."""
    latest = alerts.agg(F.max("timestamp")).scalar()
    start = F.date_sub(F.to_date(latest), days - 1).cast("timestamp")
    recent = alerts.where((F.col("timestamp") >= start) & (F.col("timestamp") <= latest))
    kind = F.col("alert_type")
    return recent.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count_if(kind == "HIGH_ACTIVITY").alias("critical"),
        F.count_if(kind.isin("ACTIVITY_DROP", "ACTIVITY_SPIKE")).alias("warn"),
    )


def missing_features(features, columns=("grid_id", "timestamp", *DROP_FEATURES)):
    """Add the list of NULL features, a status (OK or INVALID) and a message naming them."""
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    listed = features.withColumn("missing_features", names)
    broken = F.size("missing_features") > 0
    return listed.withColumns(
        {
            "quality_status": F.when(broken, "INVALID").otherwise("OK"),
            "quality_message": F.when(
                broken, F.concat(F.lit(texts.MISSING_FEATURES), F.array_join("missing_features", ", "))
            ),
        }
    )


def with_freshness(features, now):
    """Add the age in hours against `now` (never negative) and its class."""
    age = F.greatest(hours_between(now, "timestamp"), F.lit(0.0))
    return features.withColumn("age_hours", F.round(age, 2)).withColumn("freshness_status", freshness(age))


def cell_features(features, grid_id, as_of=None, now=None, low=MIN_GRID, high=MAX_GRID):
    """Feature row of a cell at `as_of` or its latest one, with quality and freshness.

    Without `now` the age is measured against the newest feature of the whole table.
    """
    own = features.where(F.col("grid_id") == valid_grid(grid_id, low, high))
    row = own.where(F.col("timestamp") == _as_of(own, as_of)).limit(1)
    clock = _time(now) if now is not None else features.agg(F.max("timestamp")).scalar()
    return with_freshness(missing_features(row), clock)


#: Layers that leave a high-water mark, and the column of the health row that it goes to.
MARKED_LAYERS = {
    "activity": "latest_raw_activity",
    "features": "latest_features_computed",
    "alerts": "latest_rule_alerts",
}


def layer_mark(layer, df):
    """One row with the latest time of a layer, for layers whose writes have left no mark."""
    return df.agg(F.max("timestamp").alias("latest")).select(F.lit(layer).alias("layer"), "latest")


def pipeline_health(marks):
    """One row: latest time per layer, status and lag verdict, from high-water marks (layer, latest).

    Runs store one mark per layer as they write it, so no layer is read, however large it is.
    """
    latest = {column: F.max(F.when(F.col("layer") == layer, F.col("latest"))) for layer, column in MARKED_LAYERS.items()}
    seen = marks.agg(*[value.alias(column) for column, value in latest.items()])
    ready = F.col("latest_features_computed").isNotNull()
    synced = F.coalesce(F.col("latest_features_computed") >= F.col("latest_raw_activity"), F.lit(False))
    return seen.withColumns(
        {
            "pipeline_status": F.when(ready, "HEALTHY").otherwise("DEGRADED"),
            "is_synchronized": synced,
            "freshness_assessment": F.when(synced, texts.LAYERS_IN_STEP).otherwise(texts.LAYERS_LAG),
        }
    )


def feature_coverage(cells, features):
    """Latest feature time and number of feature rows of every cell, NO_DATA where it has none."""
    seen = features.groupBy("grid_id").agg(
        F.max("timestamp").alias("latest_feature_timestamp"), F.count(F.lit(1)).alias("feature_records")
    )
    joined = cells.select("grid_id").join(seen, "grid_id", "left")
    return joined.withColumns(
        {
            "feature_records": F.coalesce("feature_records", F.lit(0)),
            "status": F.when(F.col("latest_feature_timestamp").isNull(), "NO_DATA").otherwise("VALID"),
        }
    )


def table_row_count(df, name):
    """One row: name and row count of a table."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")


def timed_fact(fact, times, columns=("date", "hour", "day_of_week", "day_name")):
    """Fact rows with the calendar parts the profiles need."""
    return fact_with_time(fact, times, columns)
