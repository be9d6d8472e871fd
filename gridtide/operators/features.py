"""Trailing, seasonal, spatial and calendar features of the hourly series."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide.functions.columns import (
    cycle_cos,
    cycle_sin,
    lattice_x,
    lattice_y,
    ratio_or_null,
    ratio_or_zero,
)
from gridtide.functions.windows import full_frame, series, with_merged_halves
from gridtide.operators.clean import drop_incomplete, on_dates
from gridtide.operators.enrich import with_cluster
from gridtide.operators.spatial import with_edge_neighbor_mean, with_lattice_neighbor_mean
from gridtide.schemas import (
    DROP_FEATURES,
    FORECAST_FEATURES,
    HOURS_PER_DAY,
    LATTICE_WIDTH,
    LEAKING_COLUMNS,
    forbid_columns,
)

# A drop is a next hour below this share of the trailing mean.
DROP_SHARE = 0.4


def cell_series():
    """Rows of one cell in time order."""
    return series("grid_id")


def _internet(df):
    return F.col("internet" if "internet" in df.columns else "internet_activity")


def trailing_features(hourly):
    """Features of the last 24 rows that end one row before the current one.

    One window specification for all of them, hence one shuffle and one sort by cell and time.
    """
    activity, own = F.col("total_activity"), cell_series()
    share = F.coalesce(ratio_or_null(_internet(hourly), activity), F.lit(0.0))
    lagged = hourly.withColumns(
        {
            "internet_share_at_t": F.lag(share).over(own),
            "activity_lag_24": F.lag(activity, 24).over(own),
            "next_activity": F.lead(activity).over(own),
        }
    )
    day = with_merged_halves(lagged, activity, own, 12, gap=1, prefix="__")
    return day.withColumns(
        {
            "avg_activity": F.col("__mean"),
            "active_hours": F.col("__active"),
            "peak_ratio": ratio_or_null("__top", "__mean"),
            "variability": ratio_or_null("__spread", "__mean"),
            "activity_growth": ratio_or_null("__recent_mean", "__before_mean"),
        }
    ).select(*lagged.columns, "avg_activity", "active_hours", "peak_ratio", "variability", "activity_growth")


def with_drop_label(df):
    """Add target_drop: 1 when the next hour is below 0.4 of the trailing mean, else 0."""
    below = F.col("next_activity") < DROP_SHARE * F.col("avg_activity")
    return df.withColumn("target_drop", F.coalesce(below, F.lit(False)).cast("int"))


def clock_features(df):
    """Cyclic hour, weekday counted from Monday = 0 and the ratio of data to voice."""
    calls = F.col("call_in") + F.col("call_out")
    return df.withColumns(
        {
            "hour_sin": cycle_sin("hour", 24),
            "hour_cos": cycle_cos("hour", 24),
            "day_of_week": F.weekday("timestamp"),
            "data_to_voice_ratio": ratio_or_zero(_internet(df), calls),
        }
    )


def lattice_features(df, width=LATTICE_WIDTH):
    return df.withColumns({"x": lattice_x("grid_id", width), "y": lattice_y("grid_id", width)})


FEATURE_INPUTS = ("grid_id", "timestamp", "hour", "call_in", "call_out", "internet_activity", "total_activity")


def drop_features(hourly, width=LATTICE_WIDTH):
    """Feature table of the drop detector, with target_drop; rows before a full history keep NULLs.

    A table from `stored_series` carries the neighbour mean; over it nothing is shuffled.
    """
    if "neighbor_avg_activity" in hourly.columns:
        spatial = hourly.select(*FEATURE_INPUTS, "neighbor_avg_activity")
    else:
        narrow = hourly.select(*FEATURE_INPUTS)
        spatial = with_lattice_neighbor_mean(narrow, "total_activity", "neighbor_avg_activity", width)
    return lattice_features(clock_features(with_drop_label(trailing_features(spatial))), width).select(
        "grid_id", "timestamp", *DROP_FEATURES, "target_drop"
    )


def drop_training_rows(features):
    """Rows with every feature and the label present and finite."""
    return drop_incomplete(features, (*DROP_FEATURES, "target_drop"))


def day_index(hourly):
    """(date, day_idx): dates numbered from 0. At most one row per calendar date enters the window."""
    order = Window.orderBy("date")
    return hourly.select("date").distinct().select("date", (F.row_number().over(order) - 1).alias("day_idx"))


def with_hour_index(hourly, days=None):
    """Add day_idx and the continuous hour index day_idx * 24 + hour."""
    days = day_index(hourly) if days is None else days
    # A table of distinct dates is bounded by the calendar, so it is always small enough to broadcast.
    return hourly.join(F.broadcast(days), "date").withColumn(
        "hour_index", F.col("day_idx") * HOURS_PER_DAY + F.col("hour")
    )


def lag_features(hourly):
    """Lags, full-window rolling statistics and the next-hour target of the forecast."""
    own = cell_series()
    lagged = hourly.withColumns(
        {
            "internet_lag1": F.col("internet"),
            "internet_lag2": F.lag("internet", 1).over(own),
            "internet_lag3": F.lag("internet", 2).over(own),
            "internet_lag24": F.lag("internet", 23).over(own),
            "internet_roll_mean_3": full_frame(F.avg, "internet", own, 3),
            "internet_roll_std_3": full_frame(F.stddev_samp, "internet", own, 3),
            "calls_lag1": F.col("total_calls"),
            "sms_lag1": F.col("total_sms"),
            "internet_target": F.lead("internet").over(own),
        }
    )
    day = with_merged_halves(lagged, "internet", own, 12, prefix="__")
    is_full = F.col("__n") == 24
    return day.withColumns(
        {
            "internet_roll_mean_24": F.when(is_full, F.col("__mean")),
            "internet_roll_std_24": F.when(is_full, F.col("__spread")),
        }
    ).select(*lagged.columns, "internet_roll_mean_24", "internet_roll_std_24")


def target_clock(df, first_weekday):
    """Cyclic hour and weekday of the target hour; `first_weekday` is the weekday of day 0."""
    target = F.col("hour_index") + 1
    weekday = F.pmod(first_weekday + F.floor(target / HOURS_PER_DAY), F.lit(7))
    hour = F.pmod(target, F.lit(HOURS_PER_DAY))
    return df.withColumns(
        {
            "target_hour_index": target,
            "hour_sin": cycle_sin(hour, 24),
            "hour_cos": cycle_cos(hour, 24),
            "dow_sin": cycle_sin(weekday, 7),
            "dow_cos": cycle_cos(weekday, 7),
        }
    )


def forecast_features(hourly, edges=None, clusters=None, width=LATTICE_WIDTH):
    """Feature table of the next-hour forecast, with target and target date.

    Neighbours come from `edges` when given, else from the lattice. `clusters` is (grid_id,
    cell_cluster); without it every cell has cluster -1.
    """
    base = hourly.select(
        "grid_id", "timestamp", "date", "hour", _internet(hourly).alias("internet"), "total_calls", "total_sms"
    )
    days = day_index(base)
    out = "neighbor_mean_internet_t"
    if edges is None:
        spatial = with_lattice_neighbor_mean(base, "internet", out, width)
    else:
        spatial = with_edge_neighbor_mean(base, edges, "internet", out)
    lagged = lag_features(with_hour_index(spatial, days))
    first_weekday = days.agg(F.weekday(F.min("date"))).scalar()
    timed = target_clock(lagged, first_weekday)
    targets = days.select(F.col("date").alias("target_date"), F.col("day_idx").alias("__target_day"))
    timed = timed.withColumn("__target_day", F.floor(F.col("target_hour_index") / HOURS_PER_DAY).cast("int"))
    dated = timed.join(F.broadcast(targets), "__target_day", "left").drop("__target_day")
    labelled = (
        dated.withColumn("cell_cluster", F.lit(-1)) if clusters is None else with_cluster(dated, clusters)
    )
    return labelled.select(
        "timestamp", "date", "hour_index", "target_hour_index", "target_date", "internet_target",
        *FORECAST_FEATURES,
    )


def forecast_training_rows(features):
    forbid_columns(features.select(*FORECAST_FEATURES), LEAKING_COLUMNS)
    return drop_incomplete(features, (*FORECAST_FEATURES, "internet_target"))


def leakage_check(features):
    """One row: rows whose target is not exactly one hour ahead (must be 0)."""
    return features.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("target_hour_index") - F.col("hour_index") != 1).alias("misaligned_rows"),
    )


def with_part(features, train, validation, test):
    """Add `part` (train, validation or test) by the date of the target hour, NULL outside all three."""
    part = F
    for name, dates in (("train", train), ("validation", validation), ("test", test)):
        part = part.when(F.col("target_date").isin([F.lit(day).cast("date") for day in dates]), name)
    return features.withColumn("part", part)


def date_parts(features, validation=0.2, test=0.2):
    """Three lists of dates, in order, that together hold every date of the target hours; one driver row per date."""
    days = sorted(str(row["target_date"]) for row in features.select("target_date").distinct().where("target_date IS NOT NULL").collect())
    last, middle = max(1, round(len(days) * test)), max(1, round(len(days) * validation))
    return days[: len(days) - middle - last], days[len(days) - middle - last : len(days) - last], days[len(days) - last :]


def split_by_target_date(features, train, validation, test):
    """Three frames, by the date of the target hour."""
    labelled = with_part(features, train, validation, test)
    return tuple(labelled.where(F.col("part") == name).drop("part") for name in ("train", "validation", "test"))


def chronological_cut(df, share=0.8):
    """One row (cut): first timestamp of the test part; whole hours stay on one side.

    Only the distinct timestamps with their counts pass through the ordered window.
    """
    per_hour = df.groupBy("timestamp").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("timestamp").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    placed = per_hour.select(
        "timestamp",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(whole).alias("all"),
    )
    return placed.agg(F.min(F.when(F.col("before") >= F.col("all") * share, F.col("timestamp"))).alias("cut"))


def chronological_split(df, share=0.8):
    """Earlier `share` of the rows and the rest, cut between two hours."""
    cut = chronological_cut(df, share).scalar()
    is_test = F.coalesce(F.col("timestamp") >= cut, F.lit(False))
    return df.where(~is_test), df.where(is_test)


def hourly_profiles(hourly, dates=None):
    """Mean internet activity per cell and hour of day as 24 columns, normalised to sum 1 per cell."""
    if dates is not None:
        hourly = on_dates(hourly, dates)
    value = _internet(hourly)
    means = [
        F.coalesce(F.avg(F.when(F.col("hour") == h, value)), F.lit(0.0)).alias(f"h{h:02d}")
        for h in range(HOURS_PER_DAY)
    ]
    profile = hourly.groupBy("grid_id").agg(*means)
    names = [f"h{h:02d}" for h in range(HOURS_PER_DAY)]
    total = sum((F.col(name) for name in names[1:]), F.col(names[0]))
    whole = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return profile.select("grid_id", *[ratio_or_null(name, whole).alias(name) for name in names])


def feature_summary(features, columns=None):
    """Average, minimum and maximum of every feature, one row per feature."""
    columns = columns or (
        "avg_activity", "activity_growth", "active_hours", "peak_ratio", "variability", "internet_share_at_t",
    )
    stats = [
        F.struct(
            F.lit(name).alias("feature"),
            F.avg(name).alias("avg"),
            F.min(F.col(name).cast("double")).alias("min"),
            F.max(F.col(name).cast("double")).alias("max"),
        )
        for name in columns
    ]
    return features.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def with_residual_scores(predictions, window=24, threshold=3.0):
    """Add residual, deviation of the earlier residuals, z-score and the anomaly flag.

    The deviation uses the `window` residuals before the row and needs at least half of them.
    """
    past = series("grid_id", order="target_hour_index").rowsBetween(-window, -1)
    residual = F.col("internet_target") - F.col("y_pred")
    scored = predictions.withColumn("residual", residual)
    enough = F.count("residual").over(past) >= window // 2
    scored = scored.withColumn("baseline_std", F.when(enough, F.stddev_samp("residual").over(past)))
    scored = scored.withColumn("z_score", ratio_or_null("residual", "baseline_std"))
    return scored.withColumn("is_anomaly", F.coalesce(F.abs("z_score") > threshold, F.lit(False)))


def top_anomalies(scored, n=20):
    size = F.abs("z_score")
    return scored.where(F.col("z_score").isNotNull()).orderBy(size.desc(), "grid_id", "target_hour_index").limit(n)
