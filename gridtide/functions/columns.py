"""Scalar column expressions. All of them stay inside generated JVM code."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value):
    """A Column from a name or a Column."""
    return value if isinstance(value, Column) else F.col(value)


def ratio_or_null(numerator, denominator):
    """Quotient, NULL where the denominator is zero."""
    return F.try_divide(col(numerator), col(denominator))


def ratio_or_zero(numerator, denominator):
    """Quotient where the denominator is positive, otherwise 0."""
    return F.when(col(denominator) > 0, ratio_or_null(numerator, denominator)).otherwise(F.lit(0.0))


def share_or_zero(part, whole):
    """Quotient, 0 where the whole is exactly zero."""
    return F.when(col(whole) == 0, F.lit(0.0)).otherwise(ratio_or_null(part, whole))


def cycle_sin(value, period):
    return F.sin(F.lit(2 * math.pi) * col(value) / F.lit(float(period)))


def cycle_cos(value, period):
    return F.cos(F.lit(2 * math.pi) * col(value) / F.lit(float(period)))


def lattice_x(grid_id, width):
    """Column of a cell on a lattice whose ids start at 1 and run row by row."""
    return F.pmod(col(grid_id) - 1, F.lit(width)).cast("int")


def lattice_y(grid_id, width):
    """Row of a cell on a lattice whose ids start at 1 and run row by row."""
    return F.floor((col(grid_id) - 1) / F.lit(width)).cast("int")


def lattice_id(x, y, width):
    return (col(y).cast("long") * width + col(x) + 1).cast("long")


def exact_sum(measure, scale=None):
    """Sum of a measure.

    With `scale` the values are added as integers of 10**-scale, so the total does not depend on the
    order in which shuffled rows arrive; without it this is the plain double sum.
    """
    if scale is None:
        return F.sum(col(measure))
    unit = 10**scale
    return F.sum(F.rint(col(measure) * unit).cast("long")) / F.lit(unit)


def hours_between(later, earlier):
    """Elapsed hours as a double, microseconds included."""
    micros = F.unix_micros(col(later)) - F.unix_micros(col(earlier))
    return micros / F.lit(3_600_000_000.0)


def freshness(age_hours):
    """FRESH up to 2 hours, STALE up to 6, else OUTDATED; NULL for an unknown age."""
    age = col(age_hours)
    return F.when(age <= 2, "FRESH").when(age <= 6, "STALE").when(age.isNotNull(), "OUTDATED")


def severity(label):
    """Normalise a free-text severity or alert type to critical, warn or ok."""
    text = F.lower(F.coalesce(col(label), F.lit("")))

    def has(*words):
        found = F.lit(False)
        for word in words:
            found = found | text.contains(word)
        return found

    return F.when(has("crit", "high"), "critical").when(has("warn", "elev", "med"), "warn").otherwise("ok")


def heat_class(relative):
    """Heat band of an activity relative to the busiest cell."""
    value = col(relative)
    return (
        F.when(value.isNull(), "none")
        .when(value >= 0.75, "critical")
        .when(value >= 0.5, "high")
        .when(value >= 0.22, "mid")
        .otherwise("low")
    )


def trend(percent):
    """Direction of a percent change: flat inside half a percent."""
    value = col(percent)
    return F.when(value > 0.5, "up").when(value < -0.5, "down").when(value.isNotNull(), "flat")


def day_and_hour(date, hour):
    """Timestamp of an hour of a date."""
    return F.timestamp_add("HOUR", col(hour).cast("int"), col(date).cast("timestamp"))


# Name pattern of a daily usage file.
DAILY_FILE_PATTERN = r"^sms-call-internet-mi-\d{4}-\d{2}-\d{2}\.csv$"


def is_daily_file(file_name):
    return col(file_name).rlike(DAILY_FILE_PATTERN)


def file_date(file_name):
    """Date written in a daily file name, NULL when there is none."""
    return F.try_to_date(F.nullif(F.regexp_extract(col(file_name), r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")))
