"""Writers, exports and read-back checks."""

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gridtide import texts
from gridtide.operators.alerts import alerted_share, alerts_by_type, cells_by_alerts
from gridtide.schemas import forbid_columns


def rebalanced(df, *columns):
    """Bring equal values of the columns together before a write.

    Adaptive execution then splits values that are too large for one file and merges small ones to the
    advisory partition size, so a heavy date or cell is still written by many tasks.
    """
    return df.hint("rebalance", *columns)


def write_table(df, path, by=None):
    """Overwrite a Parquet table, partitioned by `by` when given."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def stored_table(df, path, by=None):
    """Overwrite a Parquet table and read it back with the schema it was written with, so that no rows are no error."""
    write_table(df, path, by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def taken(observation):
    """Metrics of an observation whose action has ended; none where the planner saw that there are no rows and dropped it."""
    try:
        return dict(observation.get)
    except Py4JJavaError:
        return {}


def counted_table(df, path, aggregates, by=None):
    """`stored_table` of rebalanced rows, and the values of aggregates over them as a dict, taken by the write itself.

    The rows are observed behind the shuffle, in the tasks that write them, so a task that is run again counts once.
    """
    seen = Observation()
    rows = (rebalanced(df, by) if by else df).observe(seen, *aggregates)
    write_table(rows, path, by)
    counts = dict.fromkeys(df.agg(*aggregates).columns, 0) | taken(seen)
    return df.sparkSession.read.schema(df.schema).parquet(path), counts


def overwrite_partitions(df, path, by="date", gather=True):
    """Replace only the partitions present in `df`; the others stay as they are.

    Without `gather` every task writes its own rows, which suits frames that hold one partition value.
    """
    writer = (rebalanced(df, by) if gather else df).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_by_cell(df, path, files=8):
    """Overwrite a Parquet table as `files` files of similar size, cells in order.

    Range partitioning by cell and time keeps a cell in neighbouring files and still splits a heavy one.
    """
    ranged = df.repartitionByRange(files, "grid_id", "timestamp").sortWithinPartitions("grid_id", "timestamp")
    ranged.write.mode("overwrite").parquet(path)


def stored_series(df, table, path, buckets):
    """Overwrite a table of hourly rows bucketed by cell and sorted by cell and time, and read it back.

    Windows and groupings by cell, alone or with further keys, and joins by cell then read each bucket in its own task
    without a shuffle. A cell has one row per hour, so buckets stay even. Rows are brought together once, here, into one
    file per bucket.
    """
    placed = df.repartition(buckets, "grid_id").write.mode("overwrite").option("path", path)
    placed.bucketBy(buckets, "grid_id").sortBy("grid_id", "timestamp").saveAsTable(table)
    return df.sparkSession.table(table)


def write_single_csv(df, path, max_rows):
    """One CSV file with header; raises when the frame has more rows than its caller expects."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"{path}: more than {max_rows} rows for a single file")
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def write_jdbc(df, url, table, properties=None):
    df.write.mode("overwrite").jdbc(url, table, properties=properties or {})


def write_alerts(alerts, path, fmt="csv", observation=None):
    """Export alerts in time order as CSV with header or as JSON records; an observation takes their mark behind the sort."""
    ordered = alerts.orderBy("timestamp", "grid_id", "alert_type")
    if observation is not None:
        ordered = ordered.observe(observation, *mark_counts())
    if fmt == "csv":
        ordered.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        ordered.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}, use 'csv' or 'json'")


def alert_summary(alerts, hourly, floor, multipliers, percentile):
    """One row with the floor, totals, alerts by type, top 10 cells and thresholds."""
    by_type = alerts_by_type(alerts).agg(
        F.map_from_entries(F.collect_list(F.struct("alert_type", "alerts"))).alias("m")
    )
    top = cells_by_alerts(alerts, 10).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("alert_count")).alias("o"), "grid_id", "alert_count"))).alias("t")
    )
    top_rows = F.transform("top", lambda r: F.struct(r["grid_id"].alias("grid_id"), r["alert_count"].alias("alert_count")))
    levels = floor.select(F.struct("floor_value", "hourly_floor_value").alias("f")).scalar()
    thresholds = F.struct(*[F.lit(value).alias(name) for name, value in multipliers.items()])
    return (
        alerted_share(alerts, hourly)
        .withColumns({"alerts_by_type": by_type.scalar(), "top": top.scalar()})
        .select(
            F.lit(percentile).alias("floor_percentile"),
            levels["floor_value"].alias("floor_value"),
            levels["hourly_floor_value"].alias("hourly_floor_value"),
            "total_grid_hours",
            "alerted_grid_hours",
            "alerted_proportion",
            "total_alert_records",
            "alerts_by_type",
            top_rows.alias("top_10_grids_by_alert_count"),
            thresholds.alias("rule_thresholds"),
        )
    )


def write_bundle(spark, alerts, hourly, floor, path, multipliers, percentile, generated_at, fmt="json", observation=None):
    """Write alerts, summary, limitations text and a manifest below one folder.

    The summary is computed from the alerts as written, so the detector runs once.
    """
    names = {"alerts": f"network_alerts.{fmt}", "summary": "alert_summary.json",
             "limitations": "baseline_limitations.md", "manifest": "manifest.json"}
    write_alerts(alerts, f"{path}/{names['alerts']}", fmt, observation)
    stored = spark.read.schema(alerts.schema)
    stored = stored.option("header", True).csv if fmt == "csv" else stored.json
    summary = alert_summary(stored(f"{path}/{names['alerts']}"), hourly, floor, multipliers, percentile)
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/{names['summary']}")
    written = spark.read.json(f"{path}/{names['summary']}").first()
    manifest = {
        "artifact": "network_alerts",
        "schema_version": "1.0",
        "generated_at": generated_at,
        "config": {
            **multipliers,
            "floor_percentile": percentile,
            "floor_value": written["floor_value"],
            "hourly_floor_value": written["hourly_floor_value"],
        },
        "files": {kind: name for kind, name in names.items() if kind != "manifest"},
        "total_grid_hours": written["total_grid_hours"],
        "total_alerts": written["total_alert_records"],
    }
    write_text(spark, texts.BASELINE_LIMITATIONS, f"{path}/{names['limitations']}")
    write_text(spark, json.dumps(manifest), f"{path}/{names['manifest']}")
    return {kind: f"{path}/{name}" for kind, name in names.items()}


def write_text(spark, text, path):
    """A short text as a one-file text dataset."""
    lines = spark.createDataFrame([(i, line) for i, line in enumerate(text.splitlines())], "n int, value string")
    lines.coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def verify_written(df, path, forbidden=(), expected_rows=None):
    """Compare a stored Parquet table with the frame it was written from; raises on any difference."""
    stored = df.sparkSession.read.parquet(path)
    forbid_columns(stored, forbidden)
    missing = set(df.columns) - set(stored.columns)
    if missing:
        raise ValueError(f"columns lost in {path}: {sorted(missing)}")
    rows = stored.count()
    expected = df.count() if expected_rows is None else expected_rows
    if rows != expected:
        raise ValueError(f"{path} holds {rows} rows instead of {expected}")
    return stored


def storage_footprint(spark, datasets):
    """Size of every stored dataset in MB. Only file listings are read, not the contents."""
    sizes = None
    for name, path in datasets.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        one = files.select("length").agg(
            F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")
        )
        one = one.select(
            F.lit(name).alias("dataset"), "files", F.round(F.col("bytes") / 1048576.0, 4).alias("size_mb")
        )
        sizes = one if sizes is None else sizes.unionByName(one)
    return sizes


STATUS = "stage string, run_id string, status string, reason string, counts map<string,bigint>, processed_at timestamp"


def append_status(spark, path, stage, status, reason=None, run_id=None, **counts):
    """Append one run-status row: stage, run, status, reason, counts and time."""
    row = spark.createDataFrame([(stage, run_id, status, reason, {k: int(v) for k, v in counts.items()})], STATUS.rpartition(",")[0])
    row.withColumn("processed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def append_ledger(spark, path, run_id, batches):
    """Claim intake batches for a run, in one file: from then on exactly this run publishes their rows."""
    rows = spark.createDataFrame([(run_id, int(batch)) for batch in batches], "run_id string, batch_id long")
    rows.coalesce(1).write.mode("append").parquet(path)


MARKS = "run_id string, layer string, latest timestamp, rows long"


def mark_counts():
    """What a write observes for the high-water mark of its layer."""
    return [F.max(F.unix_micros("timestamp")).alias("latest_micros"), F.count(F.lit(1)).alias("rows")]


def append_mark(spark, path, run_id, layer, counts):
    """Append the high-water mark of a layer, from the counts that its write has observed; no rows leave no mark."""
    if counts.get("rows"):
        row = spark.createDataFrame([(run_id, layer, int(counts["latest_micros"]), int(counts["rows"]))], "run_id string, layer string, m long, rows long")
        row.select("run_id", "layer", F.timestamp_micros("m").alias("latest"), "rows").coalesce(1).write.mode("append").parquet(path)


def latest_status(spark, path, stage):
    """Newest status row of a stage, None when it never ran."""
    rows = spark.read.schema(STATUS).parquet(path).where(F.col("stage") == stage)
    return rows.orderBy(F.desc("processed_at")).limit(1).first()


def require_status(spark, path, stage):
    """Raise unless the newest run of the stage succeeded."""
    row = latest_status(spark, path, stage)
    if row is None:
        raise ValueError(f"no status recorded for {stage}")
    if row["status"] != "SUCCESS":
        raise ValueError(f"{stage} reported {row['status']}: {row['reason']}")
    return row
