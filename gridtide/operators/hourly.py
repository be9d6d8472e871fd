"""The hourly grid table and the aggregates over it."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide.functions.columns import exact_sum, share_or_zero
from gridtide.operators.clean import tolerant, with_totals
from gridtide.schemas import HOURLY_MEASURES, MEASURES


def _internet(df):
    return "internet" if "internet" in df.columns else "internet_activity"


def _measure_sums(df, scale):
    names = {name: name for name in MEASURES[:-1]}
    names[_internet(df)] = "internet_activity"
    return [exact_sum(source, scale).alias(target) for source, target in names.items()]


def hourly_by_cell(usage, scale=None):
    """One row per cell and timestamp: summed measures, totals and date parts; countries collapse."""
    summed = usage.groupBy("grid_id", "timestamp").agg(*_measure_sums(usage, scale))
    return with_totals(summed, "internet_activity").withColumns(
        {
            "date": F.to_date("timestamp"),
            "hour": F.hour("timestamp"),
            "day_of_week": F.dayofweek("timestamp"),
        }
    )


def with_daily_activity(hourly):
    """Attach the day total of the cell to each of its hours, as a window instead of a self-join."""
    day = Window.partitionBy("grid_id", "date")
    return hourly.withColumn("daily_activity", F.sum("total_activity").over(day))


def with_internet_share(hourly):
    return hourly.withColumn("internet_share", share_or_zero("internet_activity", "total_activity"))


def hourly_summary(usage, scale=None):
    """The full hourly grid summary: `hourly_by_cell` plus daily activity and internet share."""
    return with_internet_share(with_daily_activity(hourly_by_cell(usage, scale)))


def hourly_by_calendar(clean, scale=None):
    """Hourly aggregate of the daily run, keyed by the date parts that cleaning already derived."""
    keyed = clean.where(F.col("grid_id").isNotNull() & F.col("timestamp").isNotNull())
    summed = keyed.groupBy("grid_id", "date", "timestamp", "hour", "day_of_week").agg(
        *_measure_sums(clean, scale)
    )
    return with_totals(summed, "internet_activity")


def hourly_by_slot(usage, scale=None):
    """Hourly aggregate keyed (date, hour, cell) of loosely named input, with the record count."""
    summed = (
        tolerant(usage)
        .groupBy("date", "hour", "grid_id")
        .agg(
            *[exact_sum(name, scale).alias(name) for name in HOURLY_MEASURES],
            F.count("timestamp").alias("record_count"),
        )
    )
    total = sum((F.col(name) for name in HOURLY_MEASURES[1:]), F.col(HOURLY_MEASURES[0]))
    return summed.withColumn("total_activity", total)


def hourly_batch(usage, scale=None, by=()):
    """Hourly aggregate of the batch cleaner: internet keeps its name, weekdays count from Monday = 0.

    With `by`, for example the source file, every group is aggregated on its own.
    """
    summed = usage.groupBy(*by, "grid_id", "timestamp").agg(
        *[exact_sum(name, scale).alias(name) for name in MEASURES]
    )
    return with_totals(summed).withColumns(
        {
            "date": F.to_date("timestamp"),
            "hour": F.hour("timestamp"),
            "day_of_week": F.weekday("timestamp"),
        }
    )


def top_cells(hourly, n=10, by=("grid_id",)):
    """The n cells with the most activity; ties go to the lower id."""
    totals = hourly.groupBy(*by).agg(F.sum("total_activity").alias("window_total_activity"))
    return totals.orderBy(F.desc("window_total_activity"), *by).limit(n)


def peak_timestamp(hourly):
    """The timestamp with the most activity over all cells; ties go to the earlier one."""
    totals = hourly.groupBy("timestamp", "hour").agg(F.sum("total_activity").alias("total_activity"))
    return totals.orderBy(F.desc("total_activity"), "timestamp").limit(1)


def _kpi_sums(hourly):
    return [
        F.sum(name).alias(name) for name in ("total_sms", "total_calls", _internet(hourly), "total_activity")
    ]


def daily_kpis(hourly):
    return hourly.groupBy("date").agg(*_kpi_sums(hourly))


def cell_kpis(hourly):
    return hourly.groupBy("grid_id").agg(*_kpi_sums(hourly))


def busiest(hourly, by):
    """One row: the value of `by` with the largest summed activity; ties go to the lower value."""
    totals = hourly.groupBy(by).agg(F.sum("total_activity").alias("total_activity"))
    best = F.max(F.struct(F.col("total_activity"), (-F.col(by)).alias("k")))
    return totals.agg(best.alias("b")).select(
        (-F.col("b.k")).alias(f"busiest_{by}"),
        F.col("b.total_activity").alias(f"busiest_{by}_total_activity"),
    )


def grid_daily_totals(hourly):
    """Activity per cell and date."""
    return hourly.groupBy("grid_id", "date").agg(F.sum("total_activity").alias("total_activity"))


def countries_per_cell_hour(usage):
    """Distinct country codes per hour of day and cell."""
    return usage.groupBy("hour", "grid_id").agg(F.count_distinct("country_code").alias("country_codes"))


def distinct_values(df, by, columns=None):
    """Distinct non-null values of every other column, per group."""
    columns = columns or [name for name in df.columns if name not in by]
    return df.groupBy(*by).agg(*[F.count_distinct(F.col(name)).alias(name) for name in columns])


def rows_per_date(df):
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


def union_days(*frames):
    """Stack daily tables into one, matching columns by name."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first
