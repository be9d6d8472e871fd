"""Readers of activity files."""

from pyspark.sql import functions as F

from gridtide.operators.clean import canonical_names, parsed_time
from gridtide.schemas import USAGE_RAW, USAGE_TEXT

TIME_PATTERN = "yyyy-MM-dd HH:mm:ss"


def _require_rows(df, paths):
    if df.isEmpty():
        raise ValueError(f"no rows found in {paths}")
    return df


def read_usage(spark, paths, check_header=True):
    """Raw usage CSV files with the fixed schema; a path that matches nothing raises.

    With `check_header` a file whose header differs from the schema fails instead of being read by position.
    """
    reader = spark.read.schema(USAGE_RAW).option("header", True).option("enforceSchema", not check_header)
    return reader.csv(paths)


def read_typed_usage(spark, paths, pattern=TIME_PATTERN):
    """Raw usage files under canonical names with the time parsed."""
    named = canonical_names(read_usage(spark, paths))
    return named.withColumn("timestamp", parsed_time(named, "timestamp", pattern))


def read_text_usage(spark, paths):
    """Raw usage files with every cell as text, for checks that must see malformed cells.

    A file whose header differs from the schema in names or order fails instead of being read by position.
    """
    return spark.read.schema(USAGE_TEXT).option("header", True).option("enforceSchema", False).csv(paths)


def read_inferred(spark, paths):
    """CSV with inferred types, for small exported marts."""
    return spark.read.option("header", True).option("inferSchema", True).csv(paths)


def with_source_file(df):
    """Add the file a row came from. Call it on a fresh file scan."""
    return df.withColumns(
        {"input_file_name": F.col("_metadata.file_path"), "source": F.col("_metadata.file_name")}
    )


def read_table(spark, path, non_empty=True):
    """A stored Parquet table; raises when it is missing or empty."""
    df = spark.read.parquet(path)
    return _require_rows(df, path) if non_empty else df


def read_columns(spark, path, columns):
    """Only the named columns of a stored table; the scan reads nothing else."""
    return spark.read.parquet(path).select(*columns)


def read_alerts(spark, path):
    """Alerts exported as JSON records, with the timestamp restored."""
    schema = (
        "grid_id long, timestamp string, alert_type string, current_activity double, "
        "baseline_activity double, reason string"
    )
    return spark.read.schema(schema).json(path).withColumn("timestamp", F.try_to_timestamp("timestamp"))


def read_jdbc(spark, url, table, properties=None, partition_column=None, bounds=None, partitions=8):
    """A database table; with a partition column and bounds it is read in parallel ranges."""
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=properties or {})
    low, high = bounds
    return spark.read.jdbc(
        url, table, column=partition_column, lowerBound=low, upperBound=high, numPartitions=partitions,
        properties=properties or {},
    )
