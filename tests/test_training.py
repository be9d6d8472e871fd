"""Models on a planted signal, stored packages and the forecast run."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gridtide.operators import metrics, models
from gridtide.plans.training import train_drop_detector, train_forecast
from gridtide.schemas import DROP_FEATURES


@pytest.fixture(scope="module")
def hourly(spark, tmp_path_factory):
    """Twelve cells on a 4-wide lattice over ten days; activity collapses after every fifth hour."""
    cells = spark.range(1, 13).select(F.col("id").alias("grid_id"), F.explode(F.sequence(F.lit(0), F.lit(239))).alias("h"))
    noise = F.pmod(F.xxhash64("grid_id", "h"), F.lit(100)) / 100.0
    level = F.when(F.col("h") % 24 == 6, 1.0).otherwise(20.0 + F.col("grid_id")) + noise
    table = cells.select(
        "grid_id",
        F.timestamp_seconds(F.lit(1383264000) + F.col("h") * 3600).alias("timestamp"),
        (level * 0.2).alias("call_in"),
        (level * 0.1).alias("call_out"),
        (level * 0.3).alias("total_calls"),
        (level * 0.2).alias("total_sms"),
        (level * 0.5).alias("internet_activity"),
        level.alias("total_activity"),
    ).withColumns({"date": F.to_date("timestamp"), "hour": F.hour("timestamp")})
    path = str(tmp_path_factory.mktemp("train") / "hourly")
    table.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(("kind", "options"), [("boosted", {"maxIter": 5, "maxDepth": 3}), ("forest", {"numTrees": 10, "maxDepth": 4})])
def test_detector_finds_the_planted_drop(spark, hourly, tmp_path, kind, options):
    marks = f"{tmp_path}/marks"
    model, threshold = train_drop_detector(spark, hourly, str(tmp_path), kind, width=4, marks=marks, run_id="r", **options)
    mark = spark.read.parquet(marks).first()
    assert (mark.layer, mark.latest, mark.rows) == ("features", hourly.agg(F.max("timestamp")).first()[0], hourly.count())
    assert spark.read.parquet(f"{tmp_path}/roc_auc").first().roc_auc > 0.9
    report = {r["class"]: r for r in spark.read.parquet(f"{tmp_path}/report").collect()}
    assert report["1"].precision >= 0.65
    assert spark.read.parquet(f"{tmp_path}/importance").count() == len(DROP_FEATURES)
    loaded, names, stored = models.load_package(spark, f"{tmp_path}/package")
    assert tuple(names) == DROP_FEATURES and stored == pytest.approx(threshold)
    rows = spark.read.parquet(f"{tmp_path}/grid_features").dropna()
    flagged = models.predict_drops(loaded, rows, stored)
    assert flagged.where("anomaly_predicted").count() > 0
    newest = rows.agg(F.max("timestamp")).first()[0]
    assert models.predict_drops(loaded, rows, stored, now=str(newest)).count() == 12 * 7


def test_single_class_cannot_be_weighted(spark):
    with pytest.raises(ValueError, match="both classes"):
        models.with_class_weight(spark.createDataFrame([(0,), (0,)], "y int"), "y")
    with pytest.raises(ValueError, match="kind"):
        models.train_drop_classifier(spark.createDataFrame([(0,), (1,)], "target_drop int"), "other")


def one_class(spark, label):
    """Forty rows of every feature that share their label."""
    values = [(F.pmod(F.xxhash64("id", F.lit(name)), F.lit(100)) / 100.0).alias(name) for name in DROP_FEATURES]
    return spark.range(40).select(*values, F.lit(label).alias("target_drop"))


@pytest.mark.parametrize("label", [0, 1])
def test_importance_without_a_second_class(spark, label):
    model = models.train_drop_classifier(one_class(spark, label), maxIter=3, maxDepth=2)
    found = models.feature_importance(spark, model, DROP_FEATURES).collect()
    assert {(r.feature, r.importance) for r in found} == {(name, 0.0) for name in DROP_FEATURES}


@pytest.mark.parametrize("label", [0, 1])
def test_scores_without_a_second_class(spark, label):
    rows = one_class(spark, label)
    model = models.train_drop_classifier(rows, maxIter=3, maxDepth=2)
    assert all((r.drop_probability > 0.5) == bool(label) for r in models.drop_scores(model, rows).collect())


@pytest.mark.parametrize("label", [0, 1])
def test_boosted_predictions_without_a_second_class(spark, tmp_path, label):
    """Training, threshold and stored predictions, as the query of boosted scores runs them."""
    rows = one_class(spark, label).withColumns({"grid_id": F.monotonically_increasing_id(), "timestamp": F.timestamp_seconds(F.lit(0))})
    model = models.train_drop_classifier(rows, maxIter=3, maxDepth=2)
    threshold = metrics.best_threshold(models.drop_scores(model, rows), "drop_probability", "target_drop").first()[0]
    assert threshold > 0.5 if label else threshold == 0.5
    models.predict_drops(model, rows, threshold).write.parquet(f"{tmp_path}/scores")
    assert [r.anomaly_predicted for r in spark.read.parquet(f"{tmp_path}/scores").collect()] == [bool(label)] * 40


@pytest.mark.parametrize("label", [0, 1])
def test_forest_without_a_second_class(spark, label):
    rows = one_class(spark, label)
    model = models.train_drop_classifier(rows, "forest", numTrees=2, maxDepth=2)
    assert {r.drop_probability for r in models.drop_scores(model, rows).collect()} == {float(label)}


def test_forest_scores_are_written_after_an_observation(spark, tmp_path):
    rows = one_class(spark, 0).withColumn("target_drop", (F.col(DROP_FEATURES[0]) < 0.3).cast("int"))
    model = models.train_drop_classifier(rows, "forest", numTrees=2, maxDepth=2)
    seen = Observation("rows")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    models.drop_scores(model, rows).write.parquet(f"{tmp_path}/scores")
    assert spark.read.parquet(f"{tmp_path}/scores").count() == 40


def test_no_rows_cannot_be_trained_on(spark):
    with pytest.raises(ValueError, match="both classes"):
        models.train_drop_classifier(one_class(spark, 0).limit(0))


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "y int")
    assert {r.y: r.row_weight for r in models.with_class_weight(df, "y").collect()} == {0: 4 / 6, 1: 2.0}
    assert {r.y: r.row_weight for r in models.with_class_weight(df, "y", balanced=False).collect()} == {0: 1.0, 1: 3.0}


def test_forecast_run_beats_the_mean(spark, hourly, tmp_path):
    days = [f"2013-11-{d:02d}" for d in range(1, 11)]
    train_forecast(spark, hourly, str(tmp_path), days[:7], days[7:8], days[8:], width=4, clusters=3, maxIter=10, maxDepth=4)
    errors = {r.part: r.mae for r in spark.read.parquet(f"{tmp_path}/evaluation").collect()}
    mean = metrics.regression_metrics(
        spark.read.parquet(f"{tmp_path}/forecasts").where("part = 'test'"), "internet_target", "internet_roll_mean_24"
    ).first().mae
    assert errors["test"] < mean
    assert spark.read.parquet(f"{tmp_path}/cell_clusters").select("cell_cluster").distinct().count() <= 3
    scores = spark.read.parquet(f"{tmp_path}/anomaly_scores")
    assert scores.where("baseline_std IS NOT NULL").count() > 0
    assert spark.read.parquet(f"{tmp_path}/top_anomalies").count() == 20
