"""Star schema and daily marts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide.functions.sizes import broadcast_within
from gridtide.schemas import FACT_COLUMNS


def dim_grid(centroids):
    """One centroid per cell; of several the southernmost, then westernmost, is kept."""
    place = F.struct("centroid_latitude", "centroid_longitude")
    return (
        centroids.where(F.col("grid_id").isNotNull())
        .groupBy("grid_id")
        .agg(F.min(place).alias("p"))
        .select("grid_id", "p.centroid_latitude", "p.centroid_longitude")
    )


def dim_time(hourly):
    """One row per distinct timestamp with its calendar parts and a gapless key in time order.

    Keys are numbered inside each date and shifted by the count of the earlier dates, so the only
    globally ordered step sees one row per date.
    """
    stamps = (
        hourly.select("timestamp")
        .where(F.col("timestamp").isNotNull())
        .distinct()
        .withColumn("date", F.to_date("timestamp"))
    )
    earlier = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stamps.groupBy("date")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("date", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    )
    within = Window.partitionBy("date").orderBy("timestamp")
    return (
        stamps.withColumn("rank", F.row_number().over(within))
        .join(offsets, "date")
        .select(
            (F.col("shift") + F.col("rank")).cast("int").alias("time_key"),
            "timestamp",
            "date",
            F.year("timestamp").alias("year"),
            F.month("timestamp").alias("month"),
            F.dayofmonth("timestamp").alias("day"),
            F.hour("timestamp").alias("hour"),
            F.dayofweek("timestamp").alias("day_of_week"),
            F.date_format("timestamp", "EEEE").alias("day_name"),
        )
    )


def fact_activity(hourly, times):
    """Fact rows keyed by time and cell; the time lookup is broadcast after a size check."""
    lookup = broadcast_within(times.select("time_key", "timestamp"))
    return hourly.join(lookup, "timestamp").select(*FACT_COLUMNS)


def fact_with_time(fact, times, columns=("date", "hour")):
    return fact.join(broadcast_within(times.select("time_key", *columns)), "time_key")


def daily_metrics(timed):
    """Activity and number of active cells per date, from one row per date and cell."""
    per_cell = timed.groupBy("date", "grid_id").agg(F.sum("total_activity").alias("a"))
    return per_cell.groupBy("date").agg(
        F.sum("a").alias("total_activity"), F.count(F.lit(1)).alias("active_grids")
    )


def peak_per_date(timed, key, name):
    """The value of `key` with the most activity on every date; ties go to the lower value.

    An arg-max aggregate rather than a ranked window: each task sends one candidate per date, so a
    date that holds most of the rows does not end up in one task.
    """
    sums = timed.groupBy("date", key).agg(F.sum("total_activity").alias("a"))
    best = F.max(F.struct(F.col("a"), (-F.col(key)).alias("k")))
    return sums.groupBy("date").agg(best.alias("b")).select("date", (-F.col("b.k")).alias(name))


def day_summary(timed):
    """Daily mart: total, active cells, peak hour and top cell per date.

    One pass with two grouping sets, (date, hour) and (date, cell), then one row per date.
    """
    parts = timed.groupingSets(
        [[F.col("date"), F.col("hour")], [F.col("date"), F.col("grid_id")]], "date", "hour", "grid_id"
    ).agg(F.sum("total_activity").alias("a"), F.grouping("hour").alias("is_cell"))
    is_hour = F.col("is_cell") == 0
    peak = F.max(F.when(is_hour, F.struct(F.col("a"), (-F.col("hour")).alias("k"))))
    top = F.max(F.when(~is_hour, F.struct(F.col("a"), (-F.col("grid_id")).alias("k"))))
    return (
        parts.groupBy("date")
        .agg(
            F.sum(F.when(is_hour, F.col("a"))).alias("total_activity"),
            F.count_if(~is_hour).alias("active_grids"),
            peak.alias("p"),
            top.alias("t"),
        )
        .select(
            F.col("date").alias("summary_date"),
            "total_activity",
            "active_grids",
            (-F.col("p.k")).alias("peak_hour"),
            (-F.col("t.k")).alias("top_grid"),
        )
    )


def grid_daily_summary(timed):
    """Daily mart: activity per cell and date."""
    sums = timed.groupBy("grid_id", F.col("date").alias("day"))
    return sums.agg(F.sum("total_activity").alias("total_activity"))
