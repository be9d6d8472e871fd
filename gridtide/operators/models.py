"""Clustering, classification and regression with Spark ML."""

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from gridtide.functions.sizes import cut_lineage
from gridtide.operators.features import hourly_profiles
from gridtide.operators.metrics import imbalance
from gridtide.operators.serving import with_freshness
from gridtide.schemas import DROP_FEATURES, FORECAST_FEATURES

SEED = 42
CLUSTERS = 8
#: Gains of a split below this are rounding: residuals that are all equal have no variance.
NO_GAIN = 1e-9


def _assembler(columns):
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error")


def cluster_cells(hourly, train_dates=None, k=CLUSTERS, seed=SEED, starts=10):
    """(grid_id, cell_cluster): k-means over the normalised daily shape of the cells.

    Of `starts` runs from different seeds the one with the lowest cost counts. Shapes are stored once: one row of 24
    numbers per cell.
    """
    profiles = hourly_profiles(hourly, train_dates)
    shapes = cut_lineage(_assembler(profiles.columns[1:]).transform(profiles).select("grid_id", "features"))
    best = None
    for start in range(starts):
        model = KMeans(k=k, seed=seed + start, featuresCol="features", predictionCol="cell_cluster").fit(shapes)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best.transform(shapes).select("grid_id", "cell_cluster")


def _class_sizes(df, label):
    counts = imbalance(df, label).first()
    return counts["negatives"] or 0, counts["positives"] or 0


def with_class_weight(df, label, balanced=True):
    """Add row_weight: n / (2 n_class) when balanced, else the class ratio on positives and 1 elsewhere."""
    return _with_weight(df, label, balanced, *_class_sizes(df, label))


def _with_weight(df, label, balanced, negatives, positives):
    if not negatives or not positives:
        raise ValueError("both classes must be present")
    total = negatives + positives
    high = total / (2.0 * positives) if balanced else negatives / positives
    low = total / (2.0 * negatives) if balanced else 1.0
    return df.withColumn("row_weight", F.when(F.col(label) == 1, F.lit(high)).otherwise(F.lit(low)))


def train_drop_classifier(train, kind="boosted", features=DROP_FEATURES, label="target_drop", seed=SEED, **options):
    """Fit the drop detector: a balanced random forest or boosted trees with weighted positives.

    Rows of one class only, as of busy cells without any drop, have nothing to balance: they weigh 1 each, and the
    model is sure of their class for every row and splits on no feature.
    """
    if kind == "forest":
        settings = {"numTrees": 100, "maxDepth": 10, **options}
        learner = RandomForestClassifier(seed=seed, **settings)
    elif kind == "boosted":
        settings = {"maxIter": 50, "maxDepth": 6, **options}
        learner = GBTClassifier(seed=seed, **settings)
    else:
        raise ValueError("kind must be 'forest' or 'boosted'")
    learner = learner.setFeaturesCol("features").setLabelCol(label).setWeightCol("row_weight")
    train = cut_lineage(train.select(*features, label))  # class weights and every tree read the stored features
    negatives, positives = _class_sizes(train, label)
    if bool(negatives) != bool(positives):
        weighted = train.withColumn("row_weight", F.lit(1.0))
        learner.setMinInfoGain(NO_GAIN)
    else:
        weighted = _with_weight(train, label, kind == "forest", negatives, positives)
    weighted = weighted.withMetadata(label, {"ml_attr": {"type": "binary", "name": label}})  # two classes even where one is missing
    # A copy carries no training summary. That of a forest holds the session, which cannot be sent to tasks any more
    # once something in it was observed, so the scores could not be written.
    return Pipeline(stages=[_assembler(features), learner]).fit(weighted).copy()


def drop_scores(model, features):
    """Add drop_probability of every row."""
    scored = model.transform(features)
    scored = scored.withColumn("drop_probability", vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def predict_drops(model, features, threshold, now=None):
    """Batch scoring of every cell and hour; rows whose features are outdated at `now` are skipped."""
    if now is not None:
        aged = with_freshness(features, F.lit(now).cast("timestamp"))
        features = aged.where(F.col("freshness_status") != "OUTDATED")
    scored = drop_scores(model, features)
    return scored.select(
        "grid_id",
        F.col("timestamp").alias("prediction_timestamp"),
        (F.col("drop_probability") >= threshold).alias("anomaly_predicted"),
        F.round("drop_probability", 4).alias("drop_probability"),
        F.round(F.lit(float(threshold)), 4).alias("threshold_applied"),
    )


def train_forecaster(train, validation, features=FORECAST_FEATURES, seed=SEED, **options):
    """Boosted regression of log1p of the next hour; stops early on the validation rows."""
    settings = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "validationTol": 0.001, **options}
    rows = train.withColumn("is_validation", F.lit(False)).unionByName(
        validation.withColumn("is_validation", F.lit(True))
    )
    rows = rows.select(*features, F.log1p("internet_target").alias("log_target"), "is_validation")
    learner = GBTRegressor(
        featuresCol="features",
        labelCol="log_target",
        validationIndicatorCol="is_validation",
        seed=seed,
        **settings,
    )
    return Pipeline(stages=[_assembler(features), learner]).fit(rows)


def forecast(model, features):
    """Add y_pred, the forecast of the next hour on the original scale, never negative."""
    predicted = model.transform(features)
    return predicted.withColumn("y_pred", F.greatest(F.expm1("prediction"), F.lit(0.0))).drop(
        "features", "prediction"
    )


def feature_importance(spark, model, features):
    """(feature, importance) of a fitted tree model, one row per feature, largest first."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    table = spark.createDataFrame(list(zip(features, weights)), "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")


def save_package(spark, model, path, features, threshold):
    """Write the fitted model with the features and the threshold it needs."""
    model.write().overwrite().save(f"{path}/model")
    body = json.dumps({"features": list(features), "optimal_threshold": float(threshold)})
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_package(spark, path):
    """Return (model, features, threshold) written by `save_package`."""
    body = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    return PipelineModel.load(f"{path}/model"), body["features"], body["optimal_threshold"]

