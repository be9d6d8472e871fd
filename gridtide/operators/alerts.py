"""Rule-based alerts against a within-day leave-one-out median."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide import texts
from gridtide.functions.columns import day_and_hour, ratio_or_null
from gridtide.functions.ranks import exact_percentile
from gridtide.functions.windows import leave_one_out_median
from gridtide.operators.hourly import grid_daily_totals
from gridtide.operators.quality import with_hours_in_day
from gridtide.schemas import ALERT_COLUMNS, HOURS_PER_DAY, require_columns

# Rule multipliers and the floor percentile.
HIGH_MULTIPLIER = 2.0
DROP_MULTIPLIER = 0.5
SPIKE_MULTIPLIER = 3.0
FLOOR_PERCENTILE = 5


def cell_day():
    """All hours of one cell on one date."""
    return Window.partitionBy("grid_id", "date")


def with_baseline(hourly, expected_hours=HOURS_PER_DAY):
    """Add baseline_activity: median of the other hours of the cell's day, NULL on partial days."""
    require_columns(hourly, ("date", "grid_id", "hour", "total_activity"))
    counted = with_hours_in_day(hourly)
    scored = leave_one_out_median(counted, "total_activity", ("grid_id", "date"), out="__median")
    baseline = F.when(F.col("hours_in_day") == expected_hours, F.col("__median"))
    return scored.withColumn("baseline_activity", baseline).drop("hours_in_day", "__median")


def activity_floor(hourly, percentile=FLOOR_PERCENTILE, scale=None, totals=None):
    """One row: the percentile of cell-day totals and its hourly share.

    Pass `totals` (grid_id, date, total_activity) where they are stored already, as in the daily mart.
    """
    totals = grid_daily_totals(hourly) if totals is None else totals
    if scale is not None:
        totals = totals.withColumn("total_activity", F.round("total_activity", scale))
    return exact_percentile(totals, "total_activity", percentile / 100.0).select(
        F.col("value").alias("floor_value"), (F.col("value") / HOURS_PER_DAY).alias("hourly_floor_value")
    )


def with_floor(df, floor):
    """Add the day total of the cell, the floor values and whether the day lies below the floor."""
    values = floor.select(F.struct("floor_value", "hourly_floor_value").alias("f")).scalar()
    day_total = F.sum("total_activity").over(cell_day())
    return (
        df.withColumns({"grid_day_total_activity": day_total, "__floor": values})
        .withColumns(
            {
                "floor_value": F.col("__floor.floor_value"),
                "hourly_floor_value": F.col("__floor.hourly_floor_value"),
                "below_floor": F.col("grid_day_total_activity") < F.col("__floor.floor_value"),
            }
        )
        .drop("__floor")
    )


def with_previous_hour(df, strict_hours=False):
    """Add the activity of the previous row of the cell's day.

    With `strict_hours` a gap in the hours gives NULL instead of the last row before the gap.
    """
    ordered = cell_day().orderBy("hour")
    previous = F.lag("total_activity").over(ordered)
    if strict_hours:
        previous = F.when(F.lag("hour").over(ordered) == F.col("hour") - 1, previous)
    return df.withColumn("previous_hour_activity", previous)


def with_rule_flags(
    df,
    high=HIGH_MULTIPLIER,
    drop=DROP_MULTIPLIER,
    spike=SPIKE_MULTIPLIER,
):
    """Add one flag per rule; a row may carry several."""
    activity, baseline = F.col("total_activity"), F.col("baseline_activity")
    previous = F.col("previous_hour_activity")
    eligible = ~F.col("below_floor") & baseline.isNotNull()
    steady = ~F.col("below_floor") & previous.isNotNull() & (previous > F.col("hourly_floor_value"))

    def flag(condition):
        return F.coalesce(condition, F.lit(False))

    return df.withColumns(
        {
            "high_activity_flag": flag(eligible & (activity >= high * baseline)),
            "drop_flag": flag(eligible & (activity <= drop * baseline)),
            "spike_flag": flag(steady & (activity >= spike * previous)),
        }
    )


def score_rules(hourly, percentile=FLOOR_PERCENTILE, strict_hours=False, scale=None, floor=None, **multipliers):
    """Baseline, floor, previous hour and flags for every hourly row.

    All windows share the (cell, date) partitioning, so the table is shuffled once for them. Pass the one-row
    `floor` where it is known already.
    """
    floor = activity_floor(hourly, percentile, scale) if floor is None else floor
    based = with_baseline(with_previous_hour(hourly, strict_hours))
    return with_rule_flags(with_floor(based, floor), **multipliers)


def _reason(against, reference, multiplier):
    by_zero = F.when(F.col("total_activity") > 0, "inf").otherwise("nan")
    ratio = ratio_or_null("total_activity", reference)
    shown = F.when(ratio.isNull(), by_zero).otherwise(F.format_string("%.2f", ratio))
    return F.concat(
        F.lit(texts.ALERT_START),
        F.format_string("%.2f", "total_activity"),
        F.lit(" is "),
        shown,
        F.lit(f"x {against} of "),
        F.format_string("%.2f", reference),
        F.lit(f" (threshold {multiplier}x)"),
    )


def alert_rows(scored, high=HIGH_MULTIPLIER, drop=DROP_MULTIPLIER, spike=SPIKE_MULTIPLIER):
    """One row per triggered rule, from a single pass over the scored table."""
    if "timestamp" not in scored.columns:
        scored = scored.withColumn("timestamp", day_and_hour("date", "hour"))
    baseline, before = texts.AGAINST_BASELINE, texts.AGAINST_PREVIOUS

    def hit(flag, kind, reason):
        return F.when(F.col(flag), F.struct(F.lit(kind).alias("alert_type"), reason.alias("reason")))

    hits = F.array(
        hit("high_activity_flag", "HIGH_ACTIVITY", _reason(baseline, "baseline_activity", high)),
        hit("drop_flag", "ACTIVITY_DROP", _reason(baseline, "baseline_activity", drop)),
        hit("spike_flag", "ACTIVITY_SPIKE", _reason(before, "previous_hour_activity", spike)),
    )
    any_flag = F.col("high_activity_flag") | F.col("drop_flag") | F.col("spike_flag")
    return (
        scored.where(any_flag)
        .withColumn("hit", F.explode(F.array_compact(hits)))
        .select(
            "grid_id",
            "timestamp",
            "hit.alert_type",
            F.col("total_activity").alias("current_activity"),
            "baseline_activity",
            "hit.reason",
        )
        .select(*ALERT_COLUMNS)
    )


def detect_alerts(hourly, percentile=FLOOR_PERCENTILE, strict_hours=False, scale=None, floor=None):
    """End-to-end detector: hourly table in, alert table out. Sort it only at the sink."""
    return alert_rows(score_rules(hourly, percentile, strict_hours, scale, floor))


def alerts_by_type(alerts):
    return alerts.groupBy("alert_type").agg(F.count(F.lit(1)).alias("alerts"))


def cells_by_alerts(alerts, n=10):
    """The n cells with the most alerts; ties go to the lower id."""
    counts = alerts.groupBy("grid_id").agg(F.count(F.lit(1)).alias("alert_count"))
    return counts.orderBy(F.desc("alert_count"), "grid_id").limit(n)


def alerted_share(alerts, hourly):
    """One row: alerts, distinct alerted cell hours and their share of all cell hours."""
    total = hourly.agg(F.count(F.lit(1)).alias("n")).scalar()
    # Count alerts per cell hour first: that is the distinct step and the alert count in one shuffle.
    hours = alerts.groupBy("grid_id", "timestamp").agg(F.count(F.lit(1)).alias("n"))
    return hours.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_alert_records"),
        F.count(F.lit(1)).alias("alerted_grid_hours"),
    ).select(
        "total_alert_records",
        "alerted_grid_hours",
        total.alias("total_grid_hours"),
        F.coalesce(ratio_or_null("alerted_grid_hours", total), F.lit(0.0)).alias("alerted_proportion"),
    )


def alerted_share_of(scored):
    """`alerted_share` of scored rows, one per cell hour, in the pass that flags them."""
    flags = [F.col(name) for name in ("high_activity_flag", "drop_flag", "spike_flag")]
    raised = sum(flag.cast("long") for flag in flags)
    return scored.agg(
        F.coalesce(F.sum(raised), F.lit(0)).cast("long").alias("total_alert_records"),
        F.count_if(raised > 0).alias("alerted_grid_hours"),
        F.count(F.lit(1)).alias("total_grid_hours"),
    ).withColumn("alerted_proportion", F.coalesce(ratio_or_null("alerted_grid_hours", "total_grid_hours"), F.lit(0.0)))
