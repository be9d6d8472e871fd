"""Trailing features kept current batch by batch, without rebuilding the history.

Four tables below one folder, with a partition per batch that a replayed batch overwrites:

* history: every hourly row that has arrived; the row of a later batch replaces an earlier one of its cell and time
* tail: the last 25 rows of every cell after the batch
* features: the feature rows that the batch has changed; `current_features` takes the newest of each cell and time
* commits: one row per finished batch

A feature row reads the 24 rows before it and the one after, so a new row changes its own features, those of the row
before and those of the 24 rows after. Cells whose new rows all follow their tail need nothing but the tail. Cells with
a late or corrected row read their own history, and no other cell does.
"""

from pyspark import StorageLevel
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide.operators.features import cell_series, clock_features, trailing_features, with_drop_label
from gridtide.sources.sinks import overwrite_partitions
from gridtide.streaming.intake import stored_or_empty

KEYS = ("grid_id", "timestamp")
#: Rows before a row that its features read, and with it the rows that a tail keeps.
REACH = 24
TAIL = REACH + 1
COMMITS = "rows long, batch_id long"


def newest(rows):
    """One row per cell and time: that of the highest batch_id, of several in one batch the greatest."""
    rest = [name for name in rows.columns if name not in (*KEYS, "batch_id")]
    best = rows.groupBy(*KEYS).agg(F.max(F.struct("batch_id", *rest)).alias("best"))
    return best.select(*KEYS, "best.*")


def changed_features(rows, batch_id):
    """Features of the rows within reach of a row of this batch; `rows` holds whole histories or tails with batch_id.

    The flag uses the window of the features, so both share one shuffle and one sort.
    """
    arrived = (F.col("batch_id") == batch_id).cast("int")
    touched = rows.withColumn("__touched", F.max(arrived).over(cell_series().rowsBetween(-REACH, 1)))
    featured = clock_features(with_drop_label(trailing_features(touched)))
    return featured.where(F.col("__touched") == 1).drop("__touched", "batch_id")


def _last_rows(rows):
    backwards = Window.partitionBy("grid_id").orderBy(F.desc("timestamp"))
    ranked = rows.withColumn("__rank", F.row_number().over(backwards))
    return ranked.where(F.col("__rank") <= TAIL).drop("__rank")


def apply_batch(hourly, batch_id, out):
    """Take one batch of hourly rows into the tables below `out`; rows without cell or time are left out.

    Everything is read from batches before this one, so a replay writes what the stopped attempt wrote.
    """
    spark, number = hourly.sparkSession, F.lit(batch_id).cast("long")
    fresh = hourly.where(F.col("grid_id").isNotNull() & F.col("timestamp").isNotNull()).withColumn("batch_id", number)
    fresh = newest(fresh).select(*fresh.columns).persist(StorageLevel.DISK_ONLY)
    rows = None
    try:
        arrived = fresh.count()
        if not arrived:
            return
        commits = stored_or_empty(spark, f"{out}/commits", COMMITS).where(F.col("batch_id") < batch_id)
        before = commits.agg(F.max("batch_id").alias("b")).first()["b"]
        known = fresh
        if before is not None:
            tail = stored_or_empty(spark, f"{out}/tail", _with_origin(fresh.schema)).where(F.col("batch_id") == before)
            tail = tail.drop("batch_id").withColumnRenamed("origin", "batch_id")
            ends = tail.groupBy("grid_id").agg(F.max("timestamp").alias("end"))
            late = fresh.join(ends, "grid_id").where(F.col("timestamp") <= F.col("end")).select("grid_id").distinct()
            late = late.persist(StorageLevel.DISK_ONLY)
            if late.isEmpty():
                known = tail.unionByName(fresh)
            else:
                history = stored_or_empty(spark, f"{out}/history", fresh.schema).where(F.col("batch_id") < batch_id)
                full = history.join(late, "grid_id", "left_semi")
                known = tail.join(late, "grid_id", "left_anti").unionByName(full).unionByName(fresh)
            late.unpersist()
        rows = newest(known).select(*fresh.columns).persist(StorageLevel.DISK_ONLY)
        overwrite_partitions(fresh, f"{out}/history", "batch_id", gather=False)
        overwrite_partitions(changed_features(rows, batch_id).withColumn("batch_id", number), f"{out}/features", "batch_id", gather=False)
        kept = _last_rows(rows).withColumnRenamed("batch_id", "origin").withColumn("batch_id", number)
        overwrite_partitions(kept, f"{out}/tail", "batch_id", gather=False)
        done = spark.range(1).select(F.lit(arrived).cast("long").alias("rows"), number.alias("batch_id"))
        overwrite_partitions(done, f"{out}/commits", "batch_id", gather=False)
    finally:
        fresh.unpersist()
        if rows is not None:
            rows.unpersist()


def _with_origin(schema):
    """Columns of a stored tail: those of a batch, the batch that each row came with, and the batch of the tail."""
    columns = [field for field in schema.fields if field.name != "batch_id"]
    stored = type(schema)(columns)
    return stored.add("origin", "long").add("batch_id", "long")


def current_features(spark, out):
    """The newest feature row of every cell and time: those of `trailing_features` over all rows that have arrived."""
    return newest(spark.read.parquet(f"{out}/features")).drop("batch_id")


def keep_features(stream, out):
    """Run `apply_batch` over everything that a stream of hourly rows has to offer since the last call."""
    query = (
        stream.writeStream.option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(lambda rows, batch_id: apply_batch(rows, batch_id, out))
        .start()
    )
    query.awaitTermination()
