"""Physical plans: what reaches the scan, how tables are joined and how often they are shuffled."""

import pytest
from pyspark.sql import functions as F

from gridtide.operators import alerts, enrich, features, hourly, serving, spatial
from gridtide.plans import catalog
from gridtide.plans.binding import Tables
from gridtide.sources import sinks, usage

FOLDER = "/root/testdata/sf0.01"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hourly") / "t")
    sinks.write_table(Tables(spark, FOLDER).hourly("zone"), path, by="date")
    return path


def test_scan_reads_only_what_the_aggregate_needs(spark, stored):
    plan = plan_of(hourly.top_cells(usage.read_columns(spark, stored, ("grid_id", "total_activity"))))
    assert "ReadSchema: struct<grid_id:bigint,total_activity:double>" in plan
    assert "TakeOrderedAndProject" in plan


def test_date_filters_prune_partitions(spark, stored):
    chosen = spark.read.parquet(stored).where(F.col("date") == F.lit("2024-01-05").cast("date"))
    plan = plan_of(chosen.where(F.col("grid_id") == 2))
    assert "PartitionFilters: [isnotnull(date" in plan and "EqualTo(grid_id,2)" in plan


def test_rule_scoring_shuffles_the_table_once(spark, stored):
    table = spark.read.parquet(stored)
    scored = alerts.with_baseline(alerts.with_previous_hour(table))
    assert plan_of(scored).count("Exchange hashpartitioning") == 1


def test_feature_windows_share_one_shuffle(spark, stored):
    plan = plan_of(features.trailing_features(spark.read.parquet(stored)))
    assert plan.count("Exchange hashpartitioning") == 1


def test_neighbor_mean_and_features_need_two_shuffles(spark, stored):
    plan = plan_of(features.drop_features(spark.read.parquet(stored), 10))
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_series_stored_by_cell_need_no_shuffle(spark, stored, tmp_path):
    table = spatial.with_lattice_neighbor_mean(spark.read.parquet(stored), "total_activity", "neighbor_avg_activity", 10)
    kept = sinks.stored_series(table, "hourly_by_cell", str(tmp_path / "series"), 4)
    try:
        by_cell, direct = features.drop_features(kept, 10), features.drop_features(spark.read.parquet(stored), 10)
        assert "Exchange" not in plan_of(by_cell)
        assert "Exchange" not in plan_of(hourly.with_daily_activity(kept.drop("daily_activity")))
        totals = kept.groupBy("grid_id").agg(F.sum("total_activity").alias("cell_total")).hint("merge")
        assert "Exchange" not in plan_of(features.trailing_features(kept).join(totals, "grid_id"))
        assert by_cell.count() == direct.count() and by_cell.exceptAll(direct).isEmpty()
    finally:
        spark.sql("DROP TABLE hourly_by_cell")


def test_health_from_marks_reads_no_layer(spark, tmp_path):
    path = str(tmp_path / "marks")
    noon = 1_704_110_400_000_000
    for run, layer, micros, rows in (("a", "activity", noon, 5), ("a", "features", noon - 1, 5), ("b", "alerts", 0, 0)):
        sinks.append_mark(spark, path, run, layer, {"latest_micros": micros, "rows": rows})
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    health = serving.pipeline_health(spark.read.schema(sinks.MARKS).parquet(path))
    assert len(tracker.getJobIdsForGroup()) == before
    row = health.first()
    assert (row.pipeline_status, row.is_synchronized, row.latest_rule_alerts) == ("HEALTHY", False, None)
    sinks.append_mark(spark, path, "b", "features", {"latest_micros": noon, "rows": 1})
    again = serving.pipeline_health(spark.read.schema(sinks.MARKS).parquet(path)).first()
    assert again.is_synchronized and str(again.latest_raw_activity) == "2024-01-01 12:00:00"


def test_health_of_unmarked_layers_builds_without_jobs(spark):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    catalog.load()[0]["pipeline_health"](spark, FOLDER)
    # Opening a Parquet file reads its footer in a small job, once for each of the three layers; nothing else runs.
    assert len(tracker.getJobIdsForGroup()) <= before + 3


def test_dimension_join_is_broadcast_only_when_small(spark, stored):
    table, reference = spark.read.parquet(stored), Tables(spark, FOLDER).geometry()
    assert "BroadcastHashJoin" in plan_of(enrich.with_geometry(table, reference))
    assert "SortMergeJoin" in plan_of(enrich.with_geometry_shuffled(table, reference))


def test_no_query_leaves_the_jvm_or_multiplies_rows(spark):
    queries, oracles = catalog.load()
    for name in oracles:
        plan = plan_of(queries[name](spark, FOLDER))
        for node in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct"):
            assert node not in plan, f"{name}: {node}"
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_neighbour_search_broadcasts_only_the_coarse_cells(spark):
    points = Tables(spark, FOLDER).points()
    for plan in (plan_of(spatial.nearest_cells(points, 8)), plan_of(spatial.nearest_cells(points, 8, 1.0))):
        assert plan.count("BroadcastExchange") == 1 and plan.count("SortMergeJoin") == 4


def test_grid_step_sends_no_multiplied_points_to_the_driver(spark, tmp_path):
    Tables(spark, FOLDER).points().write.parquet(f"{tmp_path}/points")
    plan = plan_of(spatial.nearest_distances(spark.read.parquet(f"{tmp_path}/points")))
    assert plan.count("BroadcastExchange") == 1


def test_nearest_distances_send_only_the_coarse_cells_at_any_threshold(spark, tmp_path):
    """The joins that adaptive execution ends with, whatever the planner takes the sides for."""
    customers = spark.range(600).select(F.col("id").alias("c_custkey"), (F.pmod(F.xxhash64("id"), F.lit(9999)) / 1.0).alias("c_acctbal"))
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        found = catalog.load()[0]["nearest_distances"](spark, str(tmp_path))
        assert len(found.collect()) == 600
        plan = found._jdf.queryExecution().executedPlan().executedPlan().toString()
        assert plan.count("BroadcastExchange") <= 1, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
