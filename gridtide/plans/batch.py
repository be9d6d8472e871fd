"""Batch cleaning of daily files with per-file and combined exports."""

from gridtide.operators.clean import batch_counts, clean_batch
from gridtide.operators.hourly import cell_kpis, daily_kpis, hourly_batch
from gridtide.operators.quality import kpi_profile
from gridtide.sources.sinks import rebalanced, stored_table, write_table
from gridtide.sources.usage import read_text_usage, with_source_file


def run_batch(spark, paths, out):
    """Clean all files in one plan; tables are partitioned by source file instead of one loop per file.

    Exact copies are dropped within a file, because the source takes part in the comparison.
    """
    raw = with_source_file(read_text_usage(spark, paths)).drop("input_file_name")
    clean = stored_table(rebalanced(clean_batch(raw), "source"), f"{out}/cleaned", by="source")
    hourly = stored_table(rebalanced(hourly_batch(clean, by=("source",)), "source"), f"{out}/grid_hour", by="source")
    profile = kpi_profile(clean, batch_counts(raw, by=("source",)))
    write_table(profile, f"{out}/profiling_summary")
    write_table(daily_kpis(hourly), f"{out}/daily_summary")
    write_table(cell_kpis(hourly), f"{out}/grid_summary")
    return out
