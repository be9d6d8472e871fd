"""Incremental intake of a landing folder: every new file is checked once and routed as a whole.

A file stream with an availableNow trigger finds the files that arrived since the last run; its
checkpoint takes the place of moving files away. Each micro-batch writes its own partition of three
tables, raw, rejected and log, by dynamic overwrite, so a replayed batch replaces what it wrote before.
"""

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gridtide import texts
from gridtide.functions.columns import is_daily_file
from gridtide.functions.sizes import broadcast_within, cut_lineage
from gridtide.operators.quality import content_counts, verdicts
from gridtide.schemas import RAW_COLUMNS, RAW_MEASURES
from gridtide.sources.sinks import append_status, overwrite_partitions

GLOB = "*.csv"
LOG = "source string, status string, row_count long, reason string, processed_at timestamp, batch_id long"
_CELLS = ", ".join(f"{name} string" for name in (*RAW_COLUMNS, "extra"))


def with_cells(lines):
    """Split every text line into the raw columns, plus whatever follows the last one as `extra`."""
    return lines.withColumn("cells", F.from_csv("value", F.lit(_CELLS)))


def _is_header():
    matches = F.col("cells.extra").isNull()
    for name in RAW_COLUMNS:
        matches = matches & F.col(f"cells.{name}").eqNullSafe(F.lit(name))
    return matches


def file_verdicts(lines):
    """(source, status, row_count, reason) per file from its text lines.

    `lines` holds value, source, block (offset of the split in the file) and place (order in the task).
    The first line of a file is the one with the smallest place in the split at offset 0; header and
    content are judged by one aggregation over the lines.
    """
    filled = with_cells(lines.where(F.trim("value") != "")).withColumn("is_header", _is_header())
    order = F.struct("block", "place")
    counted = filled.select(
        "source", "value", "block", "place", "is_header", "cells.*"
    ).groupBy("source").agg(
        F.min_by("value", order).alias("first_line"),
        F.min_by("is_header", order).alias("header_ok"),
        F.count_if(F.col("extra").isNotNull()).alias("ragged"),
        *content_counts(),
    )
    # The header itself was counted as one row with a malformed time and non-numeric measures.
    own = ("row_count", "bad_time", *[f"{name}_text" for name in RAW_MEASURES])
    judged = verdicts(counted.withColumns({name: F.col(name) - 1 for name in own}))
    expected = "[" + ", ".join(f"'{name}'" for name in RAW_COLUMNS) + "]"
    found = F.concat(F.lit("['"), F.array_join(F.split("first_line", ","), "', '"), F.lit("']"))
    mismatch = F.concat(F.lit(texts.SCHEMA_MISMATCH.format(expected=expected)), found)
    ragged = F.concat(F.lit(texts.RAGGED), F.col("ragged").cast("string"))
    unreadable = F.when(~F.col("header_ok"), mismatch).when(F.col("ragged") > 0, ragged)
    verdict = judged.select(
        "source",
        F.when(unreadable.isNull(), F.col("status")).otherwise("REJECTED").alias("status"),
        F.when(unreadable.isNull(), F.col("row_count")).otherwise(F.lit(0)).cast("long").alias("row_count"),
        F.coalesce(unreadable, F.col("reason")).alias("reason"),
    )
    blank = lines.groupBy("source").agg(F.bool_or(F.trim("value") != "").alias("filled")).where(~F.col("filled"))
    return verdict.unionByName(blank.select("source", *_unreadable()))


def _unreadable():
    values = {"status": F.lit("REJECTED"), "row_count": F.lit(0).cast("long"), "reason": F.lit(texts.UNREADABLE)}
    return [value.alias(name) for name, value in values.items()]


def read_lines(spark, path):
    """Text lines of the files below `path` with their file and position."""
    return placed(_located(spark.read.option("pathGlobFilter", GLOB).text(path)))


def _located(lines):
    return lines.select(
        "value",
        F.col("_metadata.file_name").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
    ).where(is_daily_file("source"))


def placed(lines):
    """Add the order of the lines inside their task, which within a split is the order in the file."""
    return lines.withColumn("place", F.monotonically_increasing_id())


def stored_or_empty(spark, path, schema):
    """A table that may not exist yet; any other error of reading it is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def accepted_batches(spark, out):
    """Ids of all batches that hold a valid file, in order; one per micro-batch of accepted files so far."""
    valid = stored_or_empty(spark, f"{out}/log", LOG).where(F.col("status") == "VALID")
    return valid.select("batch_id").distinct()


def zero_byte_files(spark, landing, log):
    """Verdicts of landed files of zero bytes, which no file scan ever delivers.

    The folder is listed file by file, nothing is opened, and only names of zero-byte files are kept. Files that a
    run has judged are left out, and so are files with content: a stream has judged them or will.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(landing)
    listing = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatusIterator(path)
    names = []
    while listing.hasNext():
        entry = listing.next()
        if entry.isFile() and entry.getLen() == 0:
            names.append((entry.getPath().getName(),))
    named = spark.createDataFrame(names, "source string").where(is_daily_file("source"))
    known = stored_or_empty(spark, log, LOG).select("source")
    return named.join(known, "source", "left_anti").select("source", *_unreadable())


def _typed(rows):
    columns = {"datetime": F.col("cells.datetime"), "CellID": F.col("cells.CellID").try_cast("double").try_cast("long")}
    columns["countrycode"] = F.col("cells.countrycode").try_cast("double").try_cast("int")
    columns.update({name: F.col(f"cells.{name}").try_cast("double") for name in RAW_MEASURES})
    return rows.select("batch_id", "source", *[value.alias(name) for name, value in columns.items()])


def process_batch(lines, batch_id, out):
    """Judge the files of one batch, log the verdicts and route their rows.

    The lines are kept on the executors' disks while they are judged and routed, so each file is read once; what an
    executor loses is read again.
    """
    spark = lines.sparkSession
    lines = placed(lines).persist(StorageLevel.DISK_ONLY)
    log = f"{out}/log"
    try:
        stamp = {"batch_id": F.lit(batch_id).cast("long"), "processed_at": F.current_timestamp()}
        overwrite_partitions(file_verdicts(lines).withColumns(stamp), log, "batch_id", gather=False)
        verdicts = stored_or_empty(spark, log, LOG).where(F.col("batch_id") == batch_id)
        known = broadcast_within(verdicts.select("source", "status"))
        tagged = lines.withColumn("batch_id", F.lit(batch_id).cast("long")).join(known, "source")
        valid = with_cells(tagged.where((F.col("status") == "VALID") & (F.trim("value") != "")))
        overwrite_partitions(_typed(valid.where(~_is_header())), f"{out}/raw", "batch_id", gather=False)
        rejected = tagged.where(F.col("status") == "REJECTED").select("batch_id", "source", "block", "place", "value")
        overwrite_partitions(rejected, f"{out}/rejected", "batch_id", gather=False)
    finally:
        lines.unpersist()


def run_intake(spark, landing, out, max_files=1000):
    """Process every file that arrived since the last run and record the totals of this run.

    Returns the totals and the ids of the batches that were processed.
    """
    log, batches = f"{out}/log", []
    totals = dict.fromkeys(("total_files", "valid_files", "rejected_files", "rows_ingested"), 0)

    def process(lines, batch_id):
        process_batch(lines, batch_id, out)
        batches.append(batch_id)

    try:
        stream = spark.readStream.option("pathGlobFilter", GLOB).option("maxFilesPerTrigger", max_files)
        query = (
            _located(stream.text(landing))
            .writeStream.option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(process)
            .start()
        )
        query.awaitTermination()
        valid = F.col("status") == "VALID"
        row = stored_or_empty(spark, log, LOG).where(F.col("batch_id").isin(batches)).agg(
            F.count_if(valid).alias("valid_files"),
            F.count_if(~valid).alias("rejected_files"),
            F.coalesce(F.sum(F.when(valid, F.col("row_count"))), F.lit(0)).alias("rows_ingested"),
        )
        totals |= row.first().asDict()
        empty = cut_lineage(zero_byte_files(spark, landing, log))  # stored first, because it reads the log it goes to
        stamp = {"batch_id": F.lit(max(batches, default=-1)).cast("long"), "processed_at": F.current_timestamp()}
        empty.withColumns(stamp).write.mode("append").partitionBy("batch_id").parquet(log)
        totals["rejected_files"] += empty.count()
        totals["total_files"] = totals["valid_files"] + totals["rejected_files"]
    except Exception as error:
        append_status(spark, f"{out}/status", "intake", "FAILURE", str(error), **totals)
        raise
    append_status(spark, f"{out}/status", "intake", "SUCCESS", None, **totals)
    return {**totals, "batches": batches}
