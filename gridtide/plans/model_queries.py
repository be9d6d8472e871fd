"""Queries over training, scoring and evaluation."""

from pyspark.sql import functions as F

from gridtide.functions.sizes import cut_lineage
from gridtide.operators import features, metrics, models
from gridtide.plans.binding import WIDTH, rounded
from gridtide.plans.catalog import query
from gridtide.plans.feature_queries import DROP_ROWS_SQL, ZONE_ROWS_SQL, drop_rows, zone_forecast_rows
from gridtide.schemas import DROP_FEATURES, FORECAST_FEATURES

_SCORED_SQL = (
    "scored AS (SELECT l_quantity / 100 + l_discount * 5 AS score, CAST(l_extendedprice > 30000 AS INTEGER) AS label "
    "FROM lineitem)"
)
_GROUPED_SQL = (
    f"WITH {_SCORED_SQL}, grouped AS (SELECT ROUND(score, 6) AS score, sum(label) AS p, sum(1 - label) AS n FROM scored "
    "GROUP BY 1), curve AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM grouped WINDOW w AS (ORDER "
    "BY score DESC ROWS UNBOUNDED PRECEDING))"
)


def _scored(t):
    """Line items scored by quantity and discount; the label is a high price."""
    score = F.round(F.col("l_quantity") / 100 + F.col("l_discount") * 5, 6)
    label = (F.col("l_extendedprice") > 30000).cast("int")
    return t.read("lineitem").select(score.alias("score"), label.alias("label"))


@query(f"{_GROUPED_SQL} SELECT coalesce(min(score) FILTER (WHERE tp >= 0.65::DOUBLE * (tp + fp)), 0.5) AS threshold FROM curve")
def precision_threshold(t):
    return metrics.best_threshold(_scored(t), "score", "label", precision=0.65)


@query(
    f"{_GROUPED_SQL} SELECT ROUND(sum(CAST(p AS DOUBLE) * ((SELECT sum(n) FROM grouped) - fp + n * 0.5)) / ((SELECT "
    "sum(p) FROM grouped) * CAST((SELECT sum(n) FROM grouped) AS DOUBLE)), 6) AS roc_auc FROM curve"
)
def roc_auc(t):
    return rounded(metrics.roc_auc(_scored(t), "score", "label"), 6)


def _report_sql(label, predicted):
    def safe(a, b):
        return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"

    classes = (
        f"{safe('tn', 'tn + fn')} AS p0, {safe('tn', 'tn + fp')} AS r0, {safe('2 * tn', '2 * tn + fn + fp')} AS f0, tn + fp "
        f"AS s0, {safe('tp', 'tp + fp')} AS p1, {safe('tp', 'tp + fn')} AS r1, {safe('2 * tp', '2 * tp + fp + fn')} AS f1, "
        f"tp + fn AS s1, {safe('tp + tn', 'tp + tn + fp + fn')} AS acc"
    )

    def row(name, p, r, f, s):
        return (
            f"SELECT '{name}' AS class, ROUND({p}, 6) AS precision, ROUND({r}, 6) AS recall, ROUND({f}, 6) AS f1, "
            f"CAST({s} AS BIGINT) AS support FROM c"
        )

    def mix(a, b):
        return f"({a} * s0 + {b} * s1) / (s0 + s1)"

    return (
        f", counts AS (SELECT count(*) FILTER (WHERE {label} = 1 AND {predicted} = 1) AS tp, count(*) FILTER (WHERE "
        f"{label} = 0 AND {predicted} = 1) AS fp, count(*) FILTER (WHERE {label} = 1 AND {predicted} = 0) AS fn, count(*) "
        f"FILTER (WHERE {label} = 0 AND {predicted} = 0) AS tn FROM judged), c AS (SELECT {classes} FROM counts) "
        + " UNION ALL ".join(
            [
                row("0", "p0", "r0", "f0", "s0"),
                row("1", "p1", "r1", "f1", "s1"),
                row("accuracy", "acc", "acc", "acc", "s0 + s1"),
                row("macro avg", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1) / 2", "s0 + s1"),
                row("weighted avg", mix("p0", "p1"), mix("r0", "r1"), mix("f0", "f1"), "s0 + s1"),
            ]
        )
    )


@query(
    f"WITH {_SCORED_SQL}, judged AS (SELECT label, CAST(ROUND(score, 6) >= 0.5 AS INTEGER) AS predicted FROM scored)"
    + _report_sql("label", "predicted")
)
def classification_report(t):
    judged = _scored(t).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return rounded(metrics.classification_report(judged, "label", "predicted"), 6)


@query(f"{DROP_ROWS_SQL} SELECT target_drop, count(*) AS rows FROM rows GROUP BY target_drop")
def label_counts(t):
    return metrics.label_counts(drop_rows(t), "target_drop")


@query(
    f"{DROP_ROWS_SQL}, c AS (SELECT count(*) FILTER (WHERE target_drop = 0) AS negatives, count(*) FILTER (WHERE "
    "target_drop = 1) AS positives FROM rows) SELECT *, ROUND(CAST(negatives AS DOUBLE) / nullif(positives, 0), 6) AS "
    "imbalance_ratio FROM c"
)
def class_imbalance(t):
    return rounded(metrics.imbalance(drop_rows(t), "target_drop"), 6)


@query(
    f"{DROP_ROWS_SQL}, long AS ("
    + " UNION ALL ".join(f"SELECT '{name}' AS feature, target_drop, CAST({name} AS DOUBLE) AS v FROM rows" for name in DROP_FEATURES)
    + "), g AS (SELECT feature, target_drop, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS w FROM long GROUP BY "
    "1, 2), a AS (SELECT feature, avg(v) AS grand, count(*) AS n FROM long GROUP BY 1 HAVING min(v) <> max(v)), s AS "
    "(SELECT feature, max(a.n) AS total, count(*) AS k, sum(g.n * pow(m - grand, 2)) AS b, sum(w) AS w FROM g JOIN a "
    "USING (feature) GROUP BY 1) SELECT feature, ROUND((b / (k - 1)) / nullif(w / (total - k), 0), 4) AS f_score, k - 1 "
    "AS df_between, total - k AS df_within FROM s"
)
def anova(t):
    return rounded(metrics.anova(drop_rows(t), "target_drop", DROP_FEATURES), 4)


def _predicted(t):
    """Zone forecast rows with the mean of the last 24 hours as a plain forecast."""
    return zone_forecast_rows(t).withColumn("y_pred", F.col("internet_roll_mean_24"))


_PREDICTED_SQL = f"{ZONE_ROWS_SQL}, predicted AS (SELECT *, internet_roll_mean_24 AS y_pred FROM rows)"
_RESIDUAL_SQL = (
    f"{_PREDICTED_SQL}, residuals AS (SELECT *, internet_target - y_pred AS residual FROM predicted), based AS (SELECT *, "
    "CASE WHEN count(residual) OVER past >= 12 THEN stddev_samp(residual) OVER past END AS baseline_std FROM residuals "
    "WINDOW past AS (PARTITION BY grid_id ORDER BY target_hour_index ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)), scored "
    "AS (SELECT *, residual / nullif(baseline_std, 0) AS z_score, coalesce(abs(residual / nullif(baseline_std, 0)) > 3, "
    "false) AS is_anomaly FROM based)"
)


@query(
    f"{_PREDICTED_SQL} SELECT ROUND(avg(abs(internet_target - y_pred)), 4) AS mae, ROUND(sqrt(avg(pow(internet_target - "
    "y_pred, 2))), 4) AS rmse, ROUND(avg(abs(internet_target - y_pred) / internet_target) FILTER (WHERE internet_target > "
    "1e-6) * 100, 4) AS mape, count(*) AS rows FROM predicted"
)
def regression_metrics(t):
    return rounded(metrics.regression_metrics(_predicted(t), "internet_target", "y_pred"), 4)


@query(
    f"{_RESIDUAL_SQL} SELECT grid_id, target_hour_index, ROUND(residual, 6) AS residual, ROUND(baseline_std, 6) AS "
    "baseline_std, ROUND(z_score, 6) AS z_score, is_anomaly FROM scored"
)
def residual_scores(t):
    scored = features.with_residual_scores(_predicted(t))
    return rounded(
        scored.select("grid_id", "target_hour_index", "residual", "baseline_std", "z_score", "is_anomaly"), 6
    )


@query(
    f"{_RESIDUAL_SQL} SELECT grid_id, target_date, target_hour_index, internet_target, y_pred, ROUND(z_score, 6) AS z_score "
    "FROM scored WHERE z_score IS NOT NULL ORDER BY abs(z_score) DESC, grid_id, target_hour_index LIMIT 20"
)
def top_anomalies(t):
    top = features.top_anomalies(features.with_residual_scores(_predicted(t)))
    return rounded(
        top.select("grid_id", "target_date", "target_hour_index", "internet_target", "y_pred", "z_score"), 6
    )


@query(
    f"{_RESIDUAL_SQL}, judged AS (SELECT CAST(coalesce(internet_target < internet_roll_mean_24 * 0.5::DOUBLE, false) AS "
    "INTEGER) AS true_drop, CAST(is_anomaly AS INTEGER) AS predicted_drop FROM scored)"
    + _report_sql("true_drop", "predicted_drop")
)
def drop_flag_report(t):
    """How well the residual flag finds true drops."""
    judged = metrics.true_drops(features.with_residual_scores(_predicted(t)))
    return rounded(metrics.classification_report(judged, "true_drop", "predicted_drop"), 6)


@query()
def cell_clusters(t):
    """Cluster label per cell from its daily shape."""
    return models.cluster_cells(t.hourly())


def _trained(t, kind="boosted"):
    rows = cut_lineage(features.drop_training_rows(features.drop_features(t.hourly("zone"), WIDTH)))
    train, test = features.chronological_split(rows)
    return models.train_drop_classifier(train, kind), test


@query()
def drop_scores_boosted(t):
    """Out-of-time scores of the boosted detector with its tuned threshold."""
    model, test = _trained(t)
    threshold = metrics.best_threshold(models.drop_scores(model, test), "drop_probability", "target_drop").first()[0]
    return models.predict_drops(model, test, threshold)


@query()
def drop_scores_forest(t):
    """Out-of-time scores of the balanced forest."""
    model, test = _trained(t, "forest")
    return models.predict_drops(model, test, 0.5)


@query()
def drop_feature_importance(t):
    """Importance of every feature of the boosted detector."""
    model, _ = _trained(t)
    return models.feature_importance(t.spark, model, DROP_FEATURES)


@query()
def next_hour_forecast(t):
    """Forecast of the next hour on the last fifth of the days, with its residual anomaly score."""
    rows = cut_lineage(features.forecast_training_rows(features.forecast_features(t.hourly("zone"), width=WIDTH)))
    train, validation, test = features.split_by_target_date(rows, *features.date_parts(rows))
    model = models.train_forecaster(train, validation, FORECAST_FEATURES)
    return features.with_residual_scores(models.forecast(model, test)).select(
        "grid_id", "target_date", "target_hour_index", "internet_target", "y_pred", "z_score", "is_anomaly"
    )
