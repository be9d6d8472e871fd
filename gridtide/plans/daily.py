"""The daily run: raw usage to gated tables, then the warehouse.

Every run writes below its own folder and is published by its SUCCESS row in the status table, so
readers never see a half-written or failed run.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gridtide.operators.clean import canonical_names, clean_usage, parsed_time
from gridtide.operators.enrich import with_geometry
from gridtide.operators.hourly import hourly_by_calendar, top_cells
from gridtide.operators.quality import gate_counts, gate_of_counts, require_passed, require_tables
from gridtide.operators.warehouse import (
    day_summary,
    dim_grid,
    dim_time,
    fact_activity,
    fact_with_time,
    grid_daily_summary,
)
from gridtide.sources.geojson import centroids, grid_reference, read_features
from gridtide.schemas import CLEAN_COLUMNS, HOURLY_COLUMNS, RAW_COLUMNS, require_columns
from gridtide.sources.sinks import STATUS, append_ledger, append_mark, append_status, counted_table, mark_counts, require_status, stored_table, taken, write_single_csv, write_table
from gridtide.sources.usage import TIME_PATTERN, read_table
from gridtide.streaming.intake import accepted_batches, run_intake, stored_or_empty

PROCESSING, WAREHOUSE, ABANDONED = "processing", "warehouse", "ABANDONED"
REPORT = ("rows_in", "rows_rejected", "nulls_handled", "rows_out")


class Layers(NamedTuple):
    clean: DataFrame
    hourly: DataFrame
    enriched: DataFrame
    rules: DataFrame
    counts: dict


def gated_layers(usage, reference, store, scale=None):
    """The layers of one run, stored by `store(name, df, by, aggregates)`, with the gate's rules over their counts.

    Raw usage is read once: the cleaning report, the gate's counts and the number of published rows are taken by the
    writes. The report is counted before the shuffle of its write, where rows of a lost executor pass twice; should it
    not add up to the rows written, it is counted again from the input.
    """
    seen, wanted = Observation(), gate_counts()
    cleaned = clean_usage(usage, observation=seen)
    clean, counted = store("clean", cleaned.clean, "date", wanted["clean"])
    flow = taken(seen)
    if not flow or flow["rows_out"] != counted["rows"]:
        flow = cleaned.report.first().asDict()
    counts = {"flow": flow, "clean": counted}
    newest = mark_counts()[:1]
    hourly, counts["hourly"] = store("hourly", hourly_by_calendar(clean, scale), "date", [*wanted["hourly"], *newest])
    latest = counts["hourly"].pop("latest_micros")
    require_columns(clean, CLEAN_COLUMNS)
    require_columns(hourly, HOURLY_COLUMNS)
    # The enriched rows are joined once; the run is published by its status row, after the gate.
    enriched, counts["enriched"] = store("analytics", with_geometry(hourly, reference), "date", wanted["enriched"])
    rules = gate_of_counts(usage.sparkSession, counts)
    return Layers(clean, hourly, enriched, rules, counts | {"mark": {"latest_micros": latest, "rows": counts["hourly"]["rows"]}})


def run_processing(spark, usage, reference, out, run_id):
    """Clean, aggregate, enrich, gate and store one run; `usage` holds canonical names and parsed time.

    Every step reads back what the one before has stored, and all counts come from the writes.
    """
    base = f"{out}/{run_id}"
    counts = {}
    try:
        layers = gated_layers(usage, reference, lambda name, df, by, aggregates: counted_table(df, f"{base}/{name}", aggregates, by))
        flow = layers.counts["flow"]
        counts = {name: flow[name] for name in ("rows_in", "rows_rejected", "nulls_handled")}
        report = spark.createDataFrame([tuple(flow[name] for name in REPORT)], ", ".join(f"{name} long" for name in REPORT))
        write_table(report.coalesce(1), f"{base}/report")
        require_passed(layers.rules)
        counts["rows_published"] = layers.counts["enriched"]["rows"]
    except Exception as error:
        append_status(spark, f"{out}/status", PROCESSING, "FAILURE", str(error), run_id=run_id, **counts)
        raise
    append_mark(spark, f"{out}/marks", run_id, "activity", layers.counts["mark"])
    append_status(spark, f"{out}/status", PROCESSING, "SUCCESS", None, run_id=run_id, **counts)
    return base


def published_run(spark, out, stage=PROCESSING):
    """Run id of the newest run of a stage; raises when that run failed."""
    return require_status(spark, f"{out}/status", stage)["run_id"]


def run_warehouse(spark, cells, out):
    """Star schema and daily marts of the published run; dimensions are stored before the facts use them."""
    run_id = published_run(spark, out)
    base, written = f"{out}/{run_id}", []
    try:
        analytics = read_table(spark, f"{base}/analytics").drop("geometry")

        def store(name, df, by=None):
            write_table(df, f"{base}/warehouse/{name}", by)
            written.append(name)
            return spark.read.parquet(f"{base}/warehouse/{name}")

        grid = store("dim_grid", dim_grid(cells))
        times = store("dim_time", dim_time(analytics))
        fact = store("fact_network_activity", fact_activity(analytics, times))
        timed = fact_with_time(fact, times)
        store("day_summary", day_summary(timed))
        store("grid_daily_summary", grid_daily_summary(timed))
        require_tables({"dim_grid": grid, "dim_time": times, "fact_network_activity": fact})
    except Exception as error:
        append_status(spark, f"{out}/status", WAREHOUSE, "FAILURE", str(error), run_id=run_id, tables=len(written))
        raise
    append_status(spark, f"{out}/status", WAREHOUSE, "SUCCESS", None, run_id=run_id, tables=len(written))
    return f"{base}/warehouse"


def stored_reference(spark, geojson, out, run_id, id_offset=0):
    """Cell geometry and centroids of a GeoJSON file, parsed once and stored with the run."""
    shapes = stored_table(read_features(spark, geojson), f"{out}/{run_id}/features")
    return grid_reference(shapes, id_offset), centroids(shapes, id_offset)


def run_daily(spark, usage, geojson, out, run_id, id_offset=0):
    """Processing and warehouse of one run; geometry and centroids come from a GeoJSON file."""
    geometry, places = stored_reference(spark, geojson, out, run_id, id_offset)
    run_processing(spark, usage, geometry, out, run_id)
    return run_warehouse(spark, places, out)


def accepted_usage(spark, landing_out, batches=None):
    """Rows of accepted files from the intake's raw table under canonical names, of some batches or of all."""
    raw = read_table(spark, f"{landing_out}/raw")
    if batches is not None:
        raw = raw.where(F.col("batch_id").isin(list(batches)))
    named = canonical_names(raw.select(*RAW_COLUMNS))
    return named.withColumn("timestamp", parsed_time(named, "timestamp", TIME_PATTERN))


LEDGER = "run_id string, batch_id long"


def open_runs(spark, out):
    """{run id: batches} of runs that have claimed batches and not yet published their warehouse.

    Runs claim whole batches, so the ledger has one row per micro-batch; the anti-join leaves those of stopped runs,
    and of runs that failed: they are tried again until `abandon_run` gives them up.
    """
    claimed = stored_or_empty(spark, f"{out}/ledger", LEDGER)
    done = stored_or_empty(spark, f"{out}/status", STATUS).where((F.col("stage") == WAREHOUSE) & F.col("status").isin("SUCCESS", ABANDONED))
    left = claimed.join(done.select("run_id").distinct(), "run_id", "left_anti").orderBy("batch_id").collect()
    runs = {}
    for row in left:
        runs.setdefault(row["run_id"], []).append(row["batch_id"])
    return runs


def abandon_run(spark, out, run_id, reason):
    """Give up a run whose accepted rows cannot pass the gate; its batches stay claimed and are never published."""
    append_status(spark, f"{out}/status", WAREHOUSE, ABANDONED, reason, run_id=run_id)


def unclaimed_batches(spark, out):
    """Accepted batches of the intake that no run has claimed, in order."""
    claimed = stored_or_empty(spark, f"{out}/ledger", LEDGER).select("batch_id")
    return [row["batch_id"] for row in accepted_batches(spark, f"{out}/intake").join(claimed, "batch_id", "left_anti").orderBy("batch_id").collect()]


def run_from_landing(spark, landing, geojson, out, run_id, id_offset=0):
    """The whole chain, safe to stop anywhere: intake of new files, the gates, then processing and warehouse.

    Accepted rows reach the warehouse exactly once. A run claims the accepted batches that no run has claimed before,
    whichever call of the intake accepted them, and writes them to the ledger first. A later call finishes runs that
    have claimed and not published, under their own id and with their own batches, before it takes new ones; what
    such a run had stored is overwritten. Raises when the landing folder is empty or the intake failed. Returns the
    warehouse of the newest run, None when there was nothing to do.
    """
    require_inputs(spark, landing)
    intake = f"{out}/intake"
    run_intake(spark, landing, intake)
    require_status(spark, f"{intake}/status", "intake")
    runs = open_runs(spark, out)
    if batches := unclaimed_batches(spark, out):
        if not stored_or_empty(spark, f"{out}/ledger", LEDGER).where(F.col("run_id") == run_id).isEmpty():
            raise ValueError(f"run {run_id!r} has claimed other batches")
        append_ledger(spark, f"{out}/ledger", run_id, batches)
        runs[run_id] = batches
    warehouse = None
    for name, claimed in runs.items():
        warehouse = run_daily(spark, accepted_usage(spark, intake, claimed), geojson, out, name, id_offset)
    return warehouse


def export_dashboard(spark, out, n=10):
    """Top cells of the published run as one CSV file."""
    run_id = published_run(spark, out)
    path = f"{out}/{run_id}/dashboard_summary"
    write_single_csv(top_cells(spark.read.parquet(f"{out}/{run_id}/hourly"), n), path, max_rows=n)
    return path


def require_inputs(spark, folder, glob="*.csv"):
    """Number of input files; raises when the folder holds none. Only the listing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")
    found = files.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if not found:
        raise ValueError(f"no input files in {folder}")
    return found
