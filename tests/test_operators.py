"""Edge cases of the operators on hand-made rows."""

import math
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridtide.functions.columns import (
    file_date,
    freshness,
    heat_class,
    is_daily_file,
    severity,
    trend,
)
from gridtide.functions.ranks import exact_median, exact_percentile
from gridtide.functions.sizes import broadcast_within, fits_broadcast
from gridtide.functions.windows import leave_one_out_median
from gridtide.operators import alerts, clean, enrich, features, hourly, metrics, quality, serving, spatial, warehouse
from gridtide.schemas import MEASURES, forbid_columns, require_columns

USAGE = "timestamp timestamp, grid_id long, country_code int, sms_in double, sms_out double, call_in double, call_out double, internet double"


def usage_rows(spark, rows):
    return spark.createDataFrame(rows, USAGE.replace("timestamp timestamp", "timestamp string")).withColumn(
        "timestamp", F.try_to_timestamp("timestamp")
    )


def series(spark, values, cell=1, start="2024-01-01 00:00:00"):
    rows = [(cell, i, v) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "grid_id long, i int, total_activity double").select(
        "grid_id",
        (F.lit(start).cast("timestamp") + F.make_dt_interval(hours=F.col("i"))).alias("timestamp"),
        "total_activity",
        F.to_date(F.lit(start).cast("timestamp") + F.make_dt_interval(hours=F.col("i"))).alias("date"),
        (F.col("i") % 24).alias("hour"),
    )


def test_quarantine_and_report_add_up(spark):
    df = usage_rows(
        spark,
        [
            ("2024-01-01 00:00:00", 1, 0, 1.0, None, 2.0, None, 3.0),
            ("2024-01-01 00:00:00", None, 0, 1.0, 1.0, 1.0, 1.0, 1.0),
            ("nonsense", 1, 0, 1.0, 1.0, 1.0, 1.0, 1.0),
            ("2024-01-01 01:00:00", 1, 0, -1.0, None, None, None, None),
        ],
    )
    split = clean.quarantine(df)
    assert (split.clean.count(), split.rejected.count()) == (1, 3)
    counts = clean.quarantine_counts(df).first()
    assert (counts.raw_records, counts.rejected_records, counts.accepted_records) == (4, 3, 1)
    cleaned = clean.clean_usage(df)
    report = cleaned.report.first()
    assert (report.rows_in, report.rows_rejected, report.nulls_handled, report.rows_out) == (4, 2, 6, 2)
    assert cleaned.clean.where("hour = 1").first().sms_in == 0.0
    assert clean.clean_usage(df, negatives="reject").clean.count() == 1
    with pytest.raises(ValueError):
        clean.flag_invalid(df, negatives="other")


def test_batch_cleaning_drops_copies_and_needs_the_header(spark):
    raw = "datetime string, CellID string, countrycode string, smsin string, smsout string, callin string, callout string, internet string"
    rows = [("2024-01-01 00:00:00", "1", "0", "1", None, "-2", "x", "3")] * 2 + [("2024-01-01 00:00:00", "?", "0", "1", "1", "1", "1", "1")]
    df = spark.createDataFrame(rows, raw)
    assert clean.clean_batch(df).count() == 1
    assert clean.clean_batch(df, dedup=False).count() == 2
    assert clean.clean_batch(df).first().call_in == 0.0
    report = clean.clean_batch_report(df).first()
    assert report.asDict() == {
        "rows_loaded": 3, "rows_dropped_missing_identity": 1, "rows_with_missing_activity_filled": 2,
        "negative_activity_cells_clipped": 2, "rows_dropped_duplicates": 1,
    }
    with pytest.raises(ValueError, match="internet"):
        clean.clean_batch(df.drop("internet"))


def test_time_parsing_follows_the_column_type(spark):
    millis = spark.createDataFrame([(1383260400000,)], "timestamp long")
    parsed = millis.withColumn("timestamp", clean.parsed_time(millis))
    assert str(parsed.first().timestamp) == "2013-10-31 23:00:00"
    text = spark.createDataFrame([("2013-11-01 05:00:00",), ("31/12",)], "timestamp string")
    found = text.select(clean.parsed_time(text).alias("t")).collect()
    assert found[1].t is None and found[0].t.hour == 5
    seconds = spark.createDataFrame([(1383260400,)], "timestamp long")
    early = clean.earliest_year(seconds.withColumn("timestamp", clean.parsed_time(seconds))).first()
    assert early.min_year == 1970 and early.suspicious


def test_tolerant_fills_what_is_missing(spark):
    df = spark.createDataFrame([(1, None, 2)], "grid_id int, timestamp timestamp, sms_in_count int")
    row = clean.tolerant(df).first()
    assert (row.sms_in, row.internet_activity, str(row.date), row.hour) == (2.0, 0.0, "1970-01-01", None)


def test_incomplete_rows_are_dropped(spark):
    df = spark.createDataFrame([(1.0, 1), (math.inf, 1), (math.nan, 1), (None, 1), (1.0, None)], "a double, b int")
    assert clean.drop_incomplete(df, ("a", "b")).count() == 1


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 6), min_size=1, max_size=12))
def test_leave_one_out_median_matches_brute_force(spark, values):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "k int, i int, v double")
    got = {r.i: r.loo_median for r in leave_one_out_median(df, "v", ("k",)).collect()}
    for i in range(len(values)):
        rest = values[:i] + values[i + 1 :]
        assert got[i] == (statistics.median(rest) if rest else None)


def test_partial_day_has_no_baseline_and_spike_needs_a_floor(spark):
    full = [5.0] * 24
    full[10], full[11] = 1.0, 40.0
    table = series(spark, full).unionByName(series(spark, [5.0] * 23, cell=2)).unionByName(series(spark, [0.0] * 24, cell=3))
    scored = {(r.grid_id, r.hour): r for r in alerts.score_rules(table, percentile=1).collect()}
    assert scored[1, 11].baseline_activity == 5.0
    assert scored[1, 11].high_activity_flag and scored[1, 11].spike_flag and scored[1, 10].drop_flag
    assert scored[2, 5].baseline_activity is None and not scored[2, 5].high_activity_flag
    assert all(scored[3, h].below_floor and not scored[3, h].drop_flag for h in range(24))
    found = alerts.detect_alerts(table, percentile=1)
    kinds = sorted((r.grid_id, r.alert_type) for r in found.collect())
    assert kinds == [(1, "ACTIVITY_DROP"), (1, "ACTIVITY_SPIKE"), (1, "HIGH_ACTIVITY")]
    reasons = {r.alert_type: r.reason for r in found.collect()}
    assert reasons["HIGH_ACTIVITY"] == (
        "current activity 40.00 is 8.00x the grid's within-day median baseline of 5.00 (threshold 2.0x)"
    )
    assert reasons["ACTIVITY_SPIKE"] == (
        "current activity 40.00 is 40.00x the immediately preceding hour's activity of 1.00 (threshold 3.0x)"
    )


def test_zero_baselines_keep_their_reason_readable(spark):
    day = [0.0] * 24
    day[3] = 7.0
    table = series(spark, day)
    reasons = {r.timestamp.hour: r.reason for r in alerts.detect_alerts(table, percentile=0).where("alert_type = 'HIGH_ACTIVITY'").collect()}
    assert "is infx" in reasons[3] and "is nanx" in reasons[4]


def test_strict_hours_ignore_gaps(spark):
    table = series(spark, [1.0, None, 9.0])
    loose = {r.hour: r.previous_hour_activity for r in alerts.with_previous_hour(table).collect()}
    strict = {r.hour: r.previous_hour_activity for r in alerts.with_previous_hour(table, strict_hours=True).collect()}
    assert loose[2] == 1.0 and strict[2] is None


def test_alerts_without_timestamp_build_one(spark):
    day = [5.0] * 24
    day[7] = 50.0
    found = alerts.detect_alerts(series(spark, day).drop("timestamp"), percentile=0).first()
    assert str(found.timestamp) == "2024-01-01 07:00:00"


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=40), st.sampled_from([0.0, 0.05, 0.5, 0.98, 1.0]))
def test_percentile_interpolates_like_numpy(spark, values, fraction):
    import numpy as np

    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert exact_percentile(df, "v", fraction).first().value == pytest.approx(np.percentile(values, fraction * 100))


def test_percentile_of_many_rows_uses_the_bracket(spark):
    df = spark.range(100_001).select((F.pow(F.col("id"), 2)).alias("v"))
    for fraction in (0.05, 0.5, 0.98):
        value = exact_percentile(df, "v", fraction, accuracy=10_000).first().value
        assert value == pytest.approx((fraction * 100_000) ** 2)
    hot = spark.range(50_000).select(F.when(F.col("id") < 20_000, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    assert exact_percentile(hot, "v", 0.3).first().value == 7.0
    assert exact_percentile(hot, "v", 0.1).first().value == 7.0
    assert exact_percentile(hot, "v", 0.9).first().value == pytest.approx(44999.1)
    assert exact_median(spark.createDataFrame([], "v double"), "v").first().value is None


def test_percentile_is_a_plan_without_jobs(spark):
    df = spark.range(100_000).select(F.xxhash64("id").cast("double").alias("v"))
    spark.sparkContext.setJobGroup("lazy", "lazy")
    found = exact_percentile(df, "v", 0.37)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    spark.sparkContext.setJobGroup("other", "other")
    import numpy as np

    assert found.first().value == pytest.approx(np.percentile([row.v for row in df.collect()], 37))


def test_a_bracket_that_misses_raises_inside_the_plan(spark, monkeypatch):
    from gridtide.functions import ranks

    monkeypatch.setattr(ranks, "_around", lambda grid, first, second, n: (F.element_at(grid, 600), F.element_at(grid, 700)))
    with pytest.raises(Exception, match="bracket misses"):
        exact_percentile(spark.range(10_000).select(F.col("id").cast("double").alias("v")), "v", 0.1).collect()
    with pytest.raises(Exception, match="bracket misses"):
        exact_percentile(spark.range(10_000).select(F.col("id").cast("double").alias("v")), "v", 0.9).collect()


def test_trailing_features_head_and_zero_denominators(spark):
    values = [0.0, 0.0, 4.0] + [2.0] * 27
    table = series(spark, values).withColumn("internet_activity", F.col("total_activity") / 2)
    got = {r.timestamp.day * 24 + r.timestamp.hour - 24: r for r in features.trailing_features(table).collect()}
    assert got[0].avg_activity is None and got[0].active_hours is None
    assert got[1].avg_activity == 0.0 and got[1].peak_ratio is None and got[1].variability is None
    assert got[1].internet_share_at_t == 0.0
    assert got[3].avg_activity == pytest.approx(4 / 3) and got[3].active_hours == 1
    assert got[3].peak_ratio == pytest.approx(3.0)
    assert got[12].activity_growth is None and got[13].activity_growth is None
    assert got[15].activity_growth == pytest.approx(2.0 / (4 / 3))
    assert got[24].activity_lag_24 == 0.0 and got[23].activity_lag_24 is None
    labelled = features.with_drop_label(features.trailing_features(table))
    assert labelled.where("next_activity IS NULL").first().target_drop == 0


def test_chronological_split_keeps_hours_whole(spark):
    df = spark.createDataFrame([(h, i) for h in range(5) for i in range(3)], "h int, i int").withColumn(
        "timestamp", F.timestamp_seconds(F.col("h") * 3600)
    )
    train, test = features.chronological_split(df, 0.7)
    assert (train.count(), test.count()) == (12, 3)


def test_lattice_edges_corner_edge_centre(spark):
    cells = spark.range(1, 10).withColumnRenamed("id", "grid_id")
    counts = {r.grid_id: r["count"] for r in spatial.lattice_edges(cells, 3).groupBy("grid_id").count().collect()}
    assert [counts[i] for i in range(1, 10)] == [3, 5, 3, 5, 8, 5, 3, 5, 3]


def test_both_neighbor_means_agree_with_brute_force(spark):
    cells = [c for c in range(1, 31) if c not in (7, 12)]
    rows = [(c, t, float((c * 7 + t * 3) % 11)) for c in cells for t in (0, 1) if (c, t) != (2, 1)]
    df = spark.createDataFrame(rows, "grid_id long, timestamp int, v double")
    values = {(c, t): v for c, t, v in rows}
    lattice = spatial.with_lattice_neighbor_mean(df, "v", "m", 6).collect()
    edges = spatial.lattice_edges(spark.range(1, 31).withColumnRenamed("id", "grid_id"), 6)
    by_edges = {(r.grid_id, r.timestamp): r.m for r in spatial.with_edge_neighbor_mean(df, edges, "v", "m").collect()}
    assert len(lattice) == len(rows)
    for row in lattice:
        x, y = (row.grid_id - 1) % 6, (row.grid_id - 1) // 6
        near = [
            values[n, row.timestamp]
            for n in cells
            if (n, row.timestamp) in values and n != row.grid_id and abs((n - 1) % 6 - x) <= 1 and abs((n - 1) // 6 - y) <= 1
        ]
        expected = sum(near) / len(near) if near else None
        assert row.m == pytest.approx(expected) and by_edges[row.grid_id, row.timestamp] == pytest.approx(expected)


def brute_nearest(points, k, radius=math.inf):
    result = {}
    for i, x, y in points:
        others = sorted((math.dist((x, y), (a, b)), j) for j, a, b in points if j != i)
        result[i] = [j for d, j in others if d <= radius][:k]
    return result


@pytest.mark.parametrize("radius", [None, 0.5])
def test_nearest_cells_survive_crowds_and_copies(spark, radius):
    """A third of the points share one position, another third crowds one spot, the rest is spread out."""
    import random

    random.seed(5)
    points = [(i, 1.0, 1.0) for i in range(60)]
    points += [(100 + i, 5 + random.random() * 1e-4, 5 + random.random() * 1e-4) for i in range(60)]
    points += [(200 + i, random.random() * 10, random.random() * 10) for i in range(60)]
    df = spark.createDataFrame(points, "grid_id long, x double, y double")
    got = {i: [] for i, _, _ in points}
    for r in spatial.nearest_cells(df, 4, radius).orderBy("grid_id", "distance", "neighbor_id").collect():
        got[r.grid_id].append(r.neighbor_id)
    assert got == brute_nearest(points, 4, math.inf if radius is None else radius)


def test_nearest_of_one_point_is_empty(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)], "grid_id long, x double, y double")
    assert spatial.nearest_cells(df, 1).count() == 0
    assert spatial.distance_edges(df).count() == 0


PAIRS = [(0.9, 1), (0.9, 0), (0.8, 1), (0.8, 1), (0.7, 0), (0.7, 1), (0.6, 0), (0.6, 0), (0.5, 1), (0.5, 0),
         (0.4, 0), (0.4, 1), (0.3, 0), (0.3, 0), (0.2, 0), (0.2, 1), (0.1, 0), (0.1, 0), (0.0, 0), (1.0, 1)]


def test_threshold_and_auc_on_tied_scores(spark):
    df = spark.createDataFrame(PAIRS, "s double, y int")
    wanted = [s for s in {p[0] for p in PAIRS} if sum(y for t, y in PAIRS if t >= s) >= 0.65 * sum(1 for t, _ in PAIRS if t >= s)]
    assert metrics.best_threshold(df, "s", "y").first().threshold == min(wanted)
    assert metrics.best_threshold(df.where("y = 0"), "s", "y").first().threshold == 0.5
    positives, negatives = [s for s, y in PAIRS if y], [s for s, y in PAIRS if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in positives for n in negatives)
    assert metrics.roc_auc(df, "s", "y").first().roc_auc == pytest.approx(wins / len(positives) / len(negatives))


def test_classification_report_against_hand_counts(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 1)] * 2 + [(0, 0)] * 4, "y int, z int")
    report = {r["class"]: r for r in metrics.classification_report(df, "y", "z").collect()}
    assert report["1"].precision == 0.6 and report["1"].recall == 0.75 and report["1"].support == 4
    assert report["accuracy"].f1 == 0.7 and report["macro avg"].support == 10


def test_anova_p_values(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (0, 2.0, 5.0), (0, 3.0, 5.0), (1, 2.0, 5.0), (1, 3.0, 5.0), (1, 4.0, 5.0)], "y int, a double, c double")
    report = metrics.anova_report(df, "y", ("a", "c"))
    assert [r[0] for r in report] == ["a"] and report[0][1] == pytest.approx(1.5)
    assert report[0][2] == pytest.approx(0.2878641, abs=1e-6)


def test_regression_metrics_skip_zero_actuals(spark):
    row = metrics.regression_metrics(spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "a double, p double"), "a", "p").first()
    assert (row.mae, row.rmse, row.mape, row.rows) == (1.0, 1.0, 50.0, 2)


def test_residual_scores_need_half_a_window(spark):
    df = spark.createDataFrame([(1, i, float(i % 3), 0.0) for i in range(30)], "grid_id long, target_hour_index int, internet_target double, y_pred double")
    scored = {r.target_hour_index: r for r in features.with_residual_scores(df).collect()}
    assert scored[11].baseline_std is None and scored[12].baseline_std is not None
    assert not scored[0].is_anomaly


def test_day_summary_breaks_ties_low(spark):
    rows = [("2024-01-01", 1, 5, 2.0), ("2024-01-01", 2, 5, 2.0), ("2024-01-02", 3, 9, 1.0)]
    df = spark.createDataFrame(rows, "d string, hour int, g int, total_activity double").select(
        F.to_date("d").alias("date"), "hour", F.col("g").cast("long").alias("grid_id"), "total_activity"
    )
    twin = df.unionByName(df.withColumn("grid_id", F.col("grid_id") - 1))
    row = warehouse.day_summary(twin).orderBy("summary_date").first()
    assert (row.total_activity, row.active_grids, row.peak_hour, row.top_grid) == (8.0, 2, 1, 4)


def test_time_keys_are_gapless_over_days(spark):
    stamps = ["2024-01-01 05:00:00", "2024-01-01 23:00:00", "2024-01-03 00:00:00", "2024-01-03 00:00:00", None]
    df = spark.createDataFrame([(s,) for s in stamps], "timestamp string").select(F.try_to_timestamp("timestamp").alias("timestamp"))
    rows = warehouse.dim_time(df).orderBy("timestamp").collect()
    assert [(r.time_key, r.day_name) for r in rows] == [(1, "Monday"), (2, "Monday"), (3, "Wednesday")]


def test_cadence_notices_gaps_and_offsets(spark):
    def verdict(stamps):
        df = spark.createDataFrame([(s,) for s in stamps], "timestamp string").select(F.to_timestamp("timestamp").alias("timestamp"))
        return quality.cadence(df, points=3).first()

    assert verdict(["2024-01-01 00:30:00", "2024-01-01 01:30:00", "2024-01-01 02:30:00"]).cadence_ok
    assert not verdict(["2024-01-01 00:00:00", "2024-01-01 01:30:00", "2024-01-01 02:00:00"]).is_hourly_spacing
    assert not verdict(["2024-01-01 00:00:00", "2024-01-01 02:00:00", "2024-01-01 03:00:00"]).is_hourly_spacing
    assert not verdict(["2024-01-01 00:00:00"]).is_hourly_spacing


def test_serving_guards_and_lookups(spark):
    assert serving.valid_grid("12") == 12
    for bad in (0, 10001, "x", None):
        with pytest.raises(ValueError):
            serving.valid_grid(bad)
    assert [serving.clamped_limit(v) for v in (0, 5, 99, "x", None)] == [1, 5, 50, 10, 10]
    table = series(spark, [float(i) for i in range(60)])
    row = serving.current_and_next(table, 1, "2024-01-02 00:00:00").first()
    assert (row.current_activity, row.next_activity) == (24.0, 25.0)


def test_labels_of_single_values(spark):
    df = spark.createDataFrame(
        [("HIGH_ACTIVITY", 1.0, 0.8, 1.0), ("medium", 2.0, 0.5, -1.0), (None, 6.5, 0.22, 0.2), ("x", None, None, None)],
        "s string, age double, rel double, pct double",
    )
    rows = df.select(severity("s").alias("a"), freshness("age").alias("b"), heat_class("rel").alias("c"), trend("pct").alias("d")).collect()
    assert [tuple(r) for r in rows] == [
        ("critical", "FRESH", "critical", "up"), ("warn", "FRESH", "high", "down"), ("ok", "OUTDATED", "mid", "flat"),
        ("ok", None, "none", None),
    ]
    names = spark.createDataFrame([("sms-call-internet-mi-2013-11-01.csv",), ("a-2013-11-01.csv",), ("b.csv",)], "n string")
    got = names.select(is_daily_file("n").alias("ok"), file_date("n").alias("day")).collect()
    assert [(r.ok, str(r.day)) for r in got] == [(True, "2013-11-01"), (False, "2013-11-01"), (False, "None")]


def test_enrichment_keeps_rows_and_labels_unknown_cells(spark):
    table = series(spark, [1.0, 2.0]).unionByName(series(spark, [3.0], cell=2))
    reference = spark.createDataFrame([(1, "shape")], "grid_id long, geometry string")
    coverage = quality.enrichment_coverage(table, enrich.with_geometry(table, reference)).first()
    assert (coverage.distinct_before, coverage.missing_geometry_grids, coverage.enriched_pct) == (2, 1, 50.0)
    assert coverage.rows_preserved
    labels = spark.createDataFrame([(1, 4)], "grid_id long, cell_cluster int")
    assert {r.cell_cluster for r in enrich.with_cluster(table, labels).collect()} == {4, -1}


def test_hourly_sums_preserve_totals(spark):
    rows = [("2024-01-01 00:00:00", c, k, 0.1, None, 0.2, 0.3, 0.4) for c in (1, 2) for k in range(50)]
    filled = clean.clean_usage(usage_rows(spark, rows)).clean
    summary = hourly.hourly_summary(filled, scale=2)
    assert summary.count() == 2
    row = summary.first()
    assert (row.sms_in, row.sms_out, row.total_calls, row.daily_activity) == (5.0, 0.0, 25.0, 50.0)
    assert row.internet_share == pytest.approx(0.4)
    assert set(MEASURES) & set(summary.columns) == {"sms_in", "sms_out", "call_in", "call_out"}


def test_broadcast_only_within_the_measured_bound(spark):
    df = spark.range(1000).withColumn("s", F.lit("x" * 100))
    assert fits_broadcast(df) and not fits_broadcast(df, 1000)
    joined = spark.range(10).join(broadcast_within(df, 1000), "id")
    assert "hint" not in joined._jdf.queryExecution().logical().toString().lower()


def test_schema_guards(spark):
    df = spark.range(1)
    assert require_columns(df, ("id",)) is df and forbid_columns(df, ("geometry",)) is df
    with pytest.raises(ValueError):
        require_columns(df, ("x",))
    with pytest.raises(ValueError):
        forbid_columns(df, ("id",))


def test_partition_count(spark):
    assert quality.partition_count(spark.range(100).repartition(5)).first().partitions == 5


def test_distance_edges_take_a_fixed_number_of_jobs(spark):
    """The quadtree is counted at once, so a wide range of spacings costs no further jobs."""
    import random

    jobs = []
    for seed, spread in ((1, [1.0]), (2, [1e-5, 1e-3, 0.1, 10.0, 1e3])):
        draw = random.Random(seed)
        rows = [(i, draw.random() * spread[i % len(spread)], draw.random() * spread[i % len(spread)]) for i in range(300)]
        df = spark.createDataFrame(rows, "grid_id long, x double, y double")
        spark.sparkContext.setJobGroup(f"edges{seed}", "edges")
        spatial.distance_edges(df)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"edges{seed}")))
    spark.sparkContext.setJobGroup("other", "other")
    assert max(jobs) <= 20 and abs(jobs[0] - jobs[1]) <= 3
