"""Column names and schemas of the tables the operators exchange."""

from pyspark.sql import types as T

# Header of the raw usage files, in file order.
RAW_COLUMNS = (
    "datetime", "CellID", "countrycode", "smsin", "smsout", "callin", "callout", "internet",
)
RAW_MEASURES = ("smsin", "smsout", "callin", "callout", "internet")

# Raw name -> canonical name.
RAW_TO_CANONICAL = {
    "datetime": "timestamp",
    "CellID": "grid_id",
    "countrycode": "country_code",
    "smsin": "sms_in",
    "smsout": "sms_out",
    "callin": "call_in",
    "callout": "call_out",
    "internet": "internet",
}

# Names other producers use for the hourly measures.
LOOSE_TO_HOURLY = {
    "sms_in_count": "sms_in",
    "sms_out_count": "sms_out",
    "call_in_count": "call_in",
    "call_out_count": "call_out",
    "internet_usage": "internet_activity",
}

MEASURES = ("sms_in", "sms_out", "call_in", "call_out", "internet")
HOURLY_MEASURES = ("sms_in", "sms_out", "call_in", "call_out", "internet_activity")
TOTALS = ("total_sms", "total_calls", "total_activity")
CALENDAR = ("date", "hour", "day_of_week")

CLEAN_COLUMNS = ("timestamp", "grid_id", "country_code", *MEASURES, *CALENDAR)
HOURLY_COLUMNS = ("grid_id", "date", "timestamp", "hour", "day_of_week", *HOURLY_MEASURES, *TOTALS)
ENRICHED_COLUMNS = ("timestamp", "grid_id", *HOURLY_MEASURES, "total_activity", "geometry")
FACT_COLUMNS = ("time_key", "grid_id", *HOURLY_MEASURES, *TOTALS)
ALERT_COLUMNS = (
    "grid_id", "timestamp", "alert_type", "current_activity", "baseline_activity", "reason",
)

# Inputs of the drop detector, in model order.
DROP_FEATURES = (
    "variability", "hour", "hour_sin", "hour_cos", "internet_share_at_t", "activity_growth",
    "peak_ratio", "avg_activity", "data_to_voice_ratio", "active_hours", "day_of_week", "x", "y",
    "activity_lag_24", "neighbor_avg_activity",
)

# Inputs of the next-hour forecast, in model order.
FORECAST_FEATURES = (
    "internet_lag1", "internet_lag2", "internet_lag3", "internet_lag24", "internet_roll_mean_3",
    "internet_roll_std_3", "internet_roll_mean_24", "internet_roll_std_24", "calls_lag1",
    "sms_lag1", "neighbor_mean_internet_t", "hour_sin", "hour_cos", "dow_sin", "dow_cos",
    "cell_cluster", "grid_id",
)

# Columns of the same hour that would leak the target.
LEAKING_COLUMNS = ("total_activity", "sms_in", "sms_out", "call_in", "call_out")

HOURS_PER_DAY = 24
MIN_GRID, MAX_GRID = 1, 10_000
LATTICE_WIDTH = 100

USAGE_RAW = T.StructType(
    [
        T.StructField("datetime", T.StringType()),
        T.StructField("CellID", T.LongType()),
        T.StructField("countrycode", T.IntegerType()),
        *[T.StructField(name, T.DoubleType()) for name in RAW_MEASURES],
    ]
)
USAGE_TEXT = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])


def require_columns(df, names):
    """Raise when any of `names` is absent from the schema of `df`."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def forbid_columns(df, names):
    """Raise when any of `names` is present in the schema of `df`."""
    present = [name for name in names if name in df.columns]
    if present:
        raise ValueError(f"columns that must not be stored here: {present}")
    return df
