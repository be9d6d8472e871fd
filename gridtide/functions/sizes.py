"""Size checks in front of every broadcast, and lineage cuts."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024


def row_bytes(df):
    """Expression for the approximate in-memory size of one row."""
    total = F.lit(16)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(F.col(field.name)), F.lit(0)) + 16
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)) + 16
        else:
            total = total + 8
    return total


def fits_broadcast(df, max_bytes=BROADCAST_BYTES):
    """True when the measured size of `df` is within the broadcast bound."""
    size = df.agg(F.sum(row_bytes(df).cast("long")).alias("bytes")).first()["bytes"]
    return (size or 0) <= max_bytes


def broadcast_within(df, max_bytes=BROADCAST_BYTES):
    """Mark `df` for broadcast only when its measured size is within the bound.

    Beyond it the join stays a shuffled equi-join, where adaptive execution splits skewed keys.
    """
    return F.broadcast(df) if fits_broadcast(df, max_bytes) else df


def checkpoint_dir(spark):
    """The shared folder named by spark.checkpoint.dir; below the session's warehouse where local mode leaves it unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if spark.sparkContext.master.startswith("local["):
        return f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


def scratch_path(spark):
    """A new path below the checkpoint folder; one application's paths share a parent folder."""
    return f"{checkpoint_dir(spark)}/gridtide-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut_lineage(df):
    """Store `df` below the checkpoint folder and read it back.

    Later rounds then start from files in a shared folder: a lost executor replays nothing before them, the
    plan does not grow from round to round, and the file sizes let the planner choose the joins.
    """
    path = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark):
    """Delete what this application has stored below the checkpoint folder."""
    folder = f"{checkpoint_dir(spark)}/gridtide-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
