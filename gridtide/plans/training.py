"""Training, tuning and scoring of the drop detector and the next-hour forecast."""

from pyspark.sql import functions as F

from gridtide.operators import features as feats
from gridtide.operators import metrics, models
from gridtide.schemas import DROP_FEATURES, FORECAST_FEATURES, LATTICE_WIDTH
from gridtide.sources.sinks import append_mark, mark_counts, stored_table, write_table

TARGET_PRECISION = 0.65


def train_drop_detector(spark, hourly, out, kind="boosted", width=LATTICE_WIDTH, marks=None, run_id=None, **options):
    """Build features, train on the earlier 80 % of hours, tune the threshold, report and store.

    Features are stored once and read back, so training never recomputes the windows. With a path of `marks` the
    latest feature row is noted there, from one column of the stored table.
    """
    stored = stored_table(feats.drop_features(hourly, width), f"{out}/grid_features")
    if marks:
        append_mark(spark, marks, run_id, "features", stored.agg(*mark_counts()).first().asDict())
    rows = feats.drop_training_rows(stored)
    train, test = feats.chronological_split(rows)
    model = models.train_drop_classifier(train, kind, **options)
    write_table(models.drop_scores(model, test), f"{out}/test_scores")
    scored = spark.read.parquet(f"{out}/test_scores")
    best = metrics.best_threshold(scored, "drop_probability", "target_drop", TARGET_PRECISION)
    threshold = best.first()["threshold"]
    judged = scored.withColumn("flagged", (F.col("drop_probability") >= threshold).cast("int"))
    write_table(metrics.classification_report(judged, "target_drop", "flagged"), f"{out}/report")
    write_table(metrics.roc_auc(scored, "drop_probability", "target_drop"), f"{out}/roc_auc")
    write_table(models.feature_importance(spark, model, DROP_FEATURES), f"{out}/importance")
    models.save_package(spark, model, f"{out}/package", DROP_FEATURES, threshold)
    return model, threshold


def train_forecast(spark, hourly, out, train_dates, validation_dates, test_dates, edges=None,
                   width=LATTICE_WIDTH, clusters=models.CLUSTERS, **options):
    """Build features, fit, evaluate every part, score anomalies over all of them and store."""
    labels = models.cluster_cells(hourly, train_dates, clusters)
    write_table(labels, f"{out}/cell_clusters")
    labels = spark.read.parquet(f"{out}/cell_clusters")
    write_table(feats.forecast_features(hourly, edges, labels, width), f"{out}/features")
    rows = feats.forecast_training_rows(spark.read.parquet(f"{out}/features"))
    check = feats.leakage_check(rows).first()
    if check["misaligned_rows"]:
        raise ValueError(f"{check['misaligned_rows']} targets are not exactly one hour ahead")
    parts = feats.split_by_target_date(rows, train_dates, validation_dates, test_dates)
    model = models.train_forecaster(parts[0], parts[1], **options)
    labelled = feats.with_part(rows, train_dates, validation_dates, test_dates).where(F.col("part").isNotNull())
    write_table(models.forecast(model, labelled), f"{out}/forecasts")
    predicted = spark.read.parquet(f"{out}/forecasts")
    write_table(metrics.regression_metrics(predicted, "internet_target", "y_pred", by=("part",)), f"{out}/evaluation")
    write_table(feats.with_residual_scores(predicted), f"{out}/anomaly_scores")
    scored = spark.read.parquet(f"{out}/anomaly_scores")
    write_table(feats.top_anomalies(scored), f"{out}/top_anomalies")
    judged = metrics.true_drops(scored)
    write_table(metrics.classification_report(judged, "true_drop", "predicted_drop"), f"{out}/drop_report")
    write_table(models.feature_importance(spark, model, FORECAST_FEATURES), f"{out}/importance")
    models.save_package(spark, model, f"{out}/package", FORECAST_FEATURES, 0.0)
    return model
