"""Renaming, typing, quarantine, cleaning and derived columns of usage records."""

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.schemas import (
    HOURLY_MEASURES,
    LOOSE_TO_HOURLY,
    MAX_GRID,
    MEASURES,
    MIN_GRID,
    RAW_TO_CANONICAL,
    require_columns,
)


def canonical_names(df):
    """Rename the raw columns that are present to their canonical names."""
    return df.withColumnsRenamed({raw: name for raw, name in RAW_TO_CANONICAL.items() if raw in df.columns})


def parsed_time(df, column="timestamp", pattern=None):
    """Timestamp expression: numeric columns are epoch milliseconds, text is parsed, bad text is NULL."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.col(column)
    if isinstance(kind, T.NumericType):
        return F.timestamp_millis(F.col(column).cast("long"))
    if isinstance(kind, T.TimestampNTZType):
        return F.col(column).cast("timestamp")
    return F.try_to_timestamp(F.col(column), F.lit(pattern) if pattern else None)


def typed(df, pattern=None):
    """Cast time, ids and measures; cells that cannot be cast become NULL."""
    casts = {"timestamp": parsed_time(df, "timestamp", pattern)}
    casts["grid_id"] = F.col("grid_id").try_cast("long")
    if "country_code" in df.columns:
        casts["country_code"] = F.col("country_code").try_cast("int")
    casts.update({name: F.col(name).try_cast("double") for name in MEASURES})
    return df.withColumns(casts)


def earliest_year(df, expected_from=2000):
    """One row: first year in the data and whether it hints at a misread time unit."""
    return df.agg(F.year(F.min("timestamp")).alias("min_year")).withColumn(
        "suspicious", F.coalesce(F.col("min_year") < expected_from, F.lit(False))
    )


def tolerant(df):
    """Accept loosely named hourly inputs: rename what is there, add what is missing.

    Absent measures become 0.0, an absent date is taken from the timestamp (1970-01-01 when that is
    NULL) and an absent hour from the timestamp.
    """
    df = df.withColumnsRenamed({old: new for old, new in LOOSE_TO_HOURLY.items() if old in df.columns})
    columns = {
        name: F.col(name).cast("double") if name in df.columns else F.lit(0.0) for name in HOURLY_MEASURES
    }
    if "date" not in df.columns:
        columns["date"] = F.coalesce(F.to_date("timestamp"), F.lit("1970-01-01").cast("date"))
    if "hour" not in df.columns:
        columns["hour"] = F.hour("timestamp")
    return df.withColumns(columns)


def _any_negative(measures):
    return reduce(or_, [F.coalesce(F.col(name), F.lit(0.0)) < 0 for name in measures])


def flag_invalid(df, negatives="reject", measures=MEASURES):
    """Add `is_rejected`: NULL key or time, and with negatives="reject" any negative measure."""
    invalid = F.col("grid_id").isNull() | F.col("timestamp").isNull()
    if negatives == "reject":
        invalid = invalid | _any_negative(measures)
    elif negatives != "clamp":
        raise ValueError("negatives must be 'reject' or 'clamp'")
    return df.withColumn("is_rejected", invalid)


class Split(NamedTuple):
    clean: DataFrame
    rejected: DataFrame


def quarantine(df, negatives="reject"):
    """Split into accepted and rejected rows; both sides read the source lazily."""
    flagged = flag_invalid(df, negatives)
    return Split(
        flagged.where(~F.col("is_rejected")).drop("is_rejected"),
        flagged.where("is_rejected").drop("is_rejected"),
    )


def quarantine_counts(df, negatives="reject"):
    """One row: raw, rejected and accepted counts in one scan."""
    return flag_invalid(df, negatives).agg(
        F.count(F.lit(1)).alias("raw_records"),
        F.count_if("is_rejected").alias("rejected_records"),
        F.count_if(~F.col("is_rejected")).alias("accepted_records"),
    )


def nulls_to_zero(df, measures=MEASURES):
    return df.fillna(0.0, subset=list(measures))


def clamp_negatives(df, measures=MEASURES):
    """Raise negative measures to 0; NULL stays NULL."""
    return df.withColumns(
        {name: F.when(F.col(name) < 0, F.lit(0.0)).otherwise(F.col(name)) for name in measures}
    )


def with_totals(df, internet="internet"):
    """Add total_sms, total_calls and total_activity."""
    return df.withColumns(
        {"total_sms": F.col("sms_in") + F.col("sms_out"), "total_calls": F.col("call_in") + F.col("call_out")}
    ).withColumn("total_activity", F.col("total_sms") + F.col("total_calls") + F.col(internet))


def with_calendar(df):
    """Add date, hour, day_of_week (1 = Sunday) and weekday (0 = Monday)."""
    return df.withColumns(
        {
            "date": F.to_date("timestamp"),
            "hour": F.hour("timestamp"),
            "day_of_week": F.dayofweek("timestamp"),
            "weekday": F.weekday("timestamp"),
        }
    )


class Cleaned(NamedTuple):
    clean: DataFrame
    rejected: DataFrame
    report: DataFrame


def handled_nulls(measures=MEASURES):
    """Aggregate expression: number of NULL measure cells."""
    return F.sum(sum(F.col(name).isNull().cast("long") for name in measures))


def report_counts():
    """Aggregates of the cleaning report over rows with `is_rejected`."""
    return [
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if("is_rejected").alias("rows_rejected"),
        F.coalesce(handled_nulls(), F.lit(0)).alias("nulls_handled"),
        F.count_if(~F.col("is_rejected")).alias("rows_out"),
    ]


def clean_usage(df, negatives="clamp", observation=None):
    """Cleaning of the daily run: fill NULLs, clamp or reject negatives, reject NULL keys, add date parts.

    `report` is one row (rows_in, rows_rejected, nulls_handled, rows_out) from a single scan. With an `observation` the
    same counts are taken while the `clean` rows are written, without that scan.
    """
    flagged = flag_invalid(df, negatives)

    def filled(rows):
        return clamp_negatives(nulls_to_zero(rows)) if negatives == "clamp" else nulls_to_zero(rows)

    passing = flagged.observe(observation, *report_counts()) if observation else flagged
    return Cleaned(
        with_calendar(filled(passing).where(~F.col("is_rejected")).drop("is_rejected")),
        filled(flagged).where("is_rejected").drop("is_rejected"),
        flagged.agg(*report_counts()),
    )


def clean_batch(df, dedup=True, pattern=None):
    """Cleaning of a batch of raw files: check the header, type, drop NULL keys, clip, fill, drop copies."""
    require_columns(df, RAW_TO_CANONICAL)
    accepted = typed(canonical_names(df), pattern).dropna(subset=["timestamp", "grid_id"])
    filled = nulls_to_zero(clamp_negatives(accepted))
    return filled.dropDuplicates() if dedup else filled


def batch_counts(df, pattern=None, by=()):
    """Counts of raw rows from one scan, per group with `by`: loaded, dropped, filled, clipped, raw NULLs."""
    named = canonical_names(df)
    names = [name for name in named.columns if name not in by]
    rows = typed(named.withColumns({f"__raw_{name}": F.col(name) for name in names}), pattern)
    keyed = F.col("timestamp").isNotNull() & F.col("grid_id").isNotNull()
    blank = reduce(or_, [F.col(name).isNull() for name in MEASURES])
    negative_cells = sum(F.coalesce((F.col(name) < 0).cast("long"), F.lit(0)) for name in MEASURES)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows_loaded"),
        F.count_if(~keyed).alias("rows_dropped_missing_identity"),
        F.count_if(keyed & blank).alias("rows_with_missing_activity_filled"),
        F.coalesce(F.sum(F.when(keyed, negative_cells)), F.lit(0)).alias("negative_activity_cells_clipped"),
        *[F.count_if(F.col(f"__raw_{name}").isNull()).alias(f"{name}_nulls") for name in names],
    )


def clean_batch_report(df, pattern=None):
    """One row of counts for `clean_batch`; copies are what the distinct step removes."""
    counts = batch_counts(df, pattern)
    kept = clean_batch(df, pattern=pattern).agg(F.count(F.lit(1)).alias("n")).scalar()
    names = [name for name in counts.columns if not name.endswith("_nulls")]
    copies = F.col("rows_loaded") - F.col("rows_dropped_missing_identity") - kept
    return counts.select(*names, copies.alias("rows_dropped_duplicates"))


def between_times(df, start=None, end=None, column="timestamp"):
    """Inclusive time range; either bound may be absent."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end).cast("timestamp"))
    return df


def on_weekday_hour(df, weekday, hour):
    """Rows of one hour of one weekday (0 = Monday)."""
    return df.where((F.weekday("timestamp") == weekday) & (F.hour("timestamp") == hour))


def in_domain(df, low=MIN_GRID, high=MAX_GRID):
    return df.where(F.col("grid_id").between(low, high))


def on_dates(df, dates, column="date"):
    return df.where(F.col(column).isin([F.lit(day).cast("date") for day in dates]))


def drop_incomplete(df, columns):
    """Drop rows with a NULL, NaN or infinite value in any of the columns."""
    kinds = dict(df.dtypes)
    clean = {
        name: F.when(F.abs(F.col(name)) < F.lit(float("inf")), F.col(name))
        for name in columns
        if kinds[name] in ("double", "float")
    }
    return df.withColumns(clean).dropna(subset=list(columns)) if clean else df.dropna(subset=list(columns))
