"""Evaluation of labels, scores and forecasts."""

from math import exp, lgamma, log, log1p, pi, sqrt

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide.functions.columns import ratio_or_null
from gridtide.functions.ranks import counts_from_top


def label_counts(df, label):
    """Rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def imbalance(df, label):
    """One row: negatives, positives and their ratio."""
    counts = df.agg(F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(F.col(label) == 1).alias("positives"))
    return counts.withColumn("imbalance_ratio", ratio_or_null("negatives", "positives"))


def anova(df, label, features):
    """F statistic of a one-way analysis of variance per feature, constants skipped.

    Features are unpivoted and reduced to one row per feature and class in front of the shuffle: five
    aggregates over a long table stay in generated code, where five per feature over a wide one would not.
    `df_between` and `df_within` are the degrees of freedom of the test.
    """
    values = F.array(
        *[F.struct(F.lit(name).alias("feature"), F.col(name).cast("double").alias("v")) for name in features]
    )
    rows = (
        df.select(label, F.inline(values))
        .groupBy("feature", label)
        .agg(
            F.count("v").alias("n"),
            F.avg("v").alias("mean"),
            F.var_pop("v").alias("variance"),
            F.min("v").alias("least"),
            F.max("v").alias("most"),
        )
    )
    # One row per feature and class: the window sees a feature's classes, the sums are taken around its grand mean.
    of_feature = Window.partitionBy("feature")
    grand = F.sum(F.col("n") * F.col("mean")).over(of_feature) / F.sum("n").over(of_feature)
    parts = rows.withColumn("grand", grand).groupBy("feature").agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("classes"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("between"),
        F.sum(F.col("n") * F.col("variance")).alias("within"),
        (F.min("least") == F.max("most")).alias("constant"),
    )
    return (
        parts.where(~F.col("constant"))
        .withColumn("df_between", F.col("classes") - 1)
        .withColumn("df_within", F.col("total") - F.col("classes"))
        .withColumn(
            "f_score",
            ratio_or_null(F.col("between") / F.col("df_between"), F.col("within") / F.col("df_within")),
        )
        .select("feature", "f_score", "df_between", "df_within")
    )


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz evaluation).

    It converges in about sqrt(max(a, b)) steps where it is used; far more raise.
    """
    tiny, most = 1e-300, 1000 + 20 * int(sqrt(max(a, b)))
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, most):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-14:
            return value
    raise ArithmeticError(f"incomplete beta function does not converge for {a}, {b}, {x}")


def _stirling_rest(z):
    """log gamma(z) minus Stirling's formula."""
    if z < 10:
        return lgamma(z) - (0.5 * log(2 * pi / z) + z * log(z) - z)
    return 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)


def f_tail(f_score, df_between, df_within):
    """Upper tail probability of the F distribution, also for very many degrees of freedom.

    The front factor x^a (1 - x)^b / B(a, b) is taken from Stirling's formula with its rest and from the relative
    distances of x and 1 - x to a / (a + b) and b / (a + b): large logarithms, which would cancel, never appear.
    """
    if f_score is None or f_score <= 0:
        return 1.0
    a, b = df_within / 2.0, df_between / 2.0
    spread = df_within + df_between * f_score
    x, rest = df_within / spread, df_between * f_score / spread
    if x <= 0.0:
        return 0.0
    distance = a * log1p(df_between * (1 - f_score) / spread) + b * log1p(df_within * (f_score - 1) / spread)
    stirling = _stirling_rest(a + b) - _stirling_rest(a) - _stirling_rest(b)
    front = sqrt(a * b / (2 * pi * (a + b))) * exp(distance + stirling)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, rest) / b


def anova_report(df, label, features):
    """List of (feature, f_score, p_value), largest F first; one driver row per feature."""
    rows = anova(df, label, features).collect()
    report = [(r.feature, r.f_score, f_tail(r.f_score, r.df_between, r.df_within)) for r in rows]
    return sorted(report, key=lambda r: (r[1] is not None, r[1], r[0]), reverse=True)


def best_threshold(df, score, label, precision=0.65, default=0.5):
    """One row: the lowest score whose precision reaches the wanted one, else the default."""
    curve = counts_from_top(df, score, label)
    reached = F.col("true_positives") >= precision * (F.col("true_positives") + F.col("false_positives"))
    lowest = F.min(F.when(reached, F.col("score")))
    return curve.agg(F.coalesce(lowest, F.lit(default)).alias("threshold"))


def roc_auc(df, score, label):
    """One row: area under the ROC curve, tied scores counting half."""
    curve = counts_from_top(df, score, label)
    # Per score: negatives strictly below it are all negatives minus those at or above.
    totals = F.struct(F.sum("positives").alias("p"), F.sum("negatives").alias("n")).alias("t")
    sums = curve.agg(
        totals,
        F.sum(F.col("positives") * F.col("false_positives").cast("double")).alias("at_or_above"),
        F.sum(F.col("positives") * F.col("negatives").cast("double")).alias("tied"),
    )
    p, n = F.col("t.p").cast("double"), F.col("t.n").cast("double")
    wins = p * n - F.col("at_or_above") + F.col("tied") * 0.5
    return sums.select(ratio_or_null(wins, p * n).alias("roc_auc"))


def confusion(df, label, predicted):
    """One row of counts: tp, fp, fn, tn."""
    y, z = F.col(label) == 1, F.col(predicted) == 1
    return df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).agg(
        F.count_if(y & z).alias("tp"),
        F.count_if(~y & z).alias("fp"),
        F.count_if(y & ~z).alias("fn"),
        F.count_if(~y & ~z).alias("tn"),
    )


def classification_report(df, label, predicted):
    """Precision, recall, F1 and support for both classes, accuracy, macro and weighted averages."""
    counts = confusion(df, label, predicted)

    def zero(numerator, denominator):
        return F.coalesce(ratio_or_null(numerator, denominator), F.lit(0.0))

    def scores(hit, false_hit, missed):
        precision = zero(F.col(hit), F.col(hit) + F.col(false_hit))
        recall = zero(F.col(hit), F.col(hit) + F.col(missed))
        f1 = zero(2 * F.col(hit), 2 * F.col(hit) + F.col(false_hit) + F.col(missed))
        return precision, recall, f1, F.col(hit) + F.col(missed)

    zero_class, one_class = scores("tn", "fn", "fp"), scores("tp", "fp", "fn")
    total = zero_class[3] + one_class[3]
    accuracy = zero(F.col("tp") + F.col("tn"), total)

    def row(name, values, support):
        return F.struct(
            F.lit(name).alias("class"),
            *[v.cast("double").alias(n) for n, v in zip(("precision", "recall", "f1"), values)],
            support.cast("long").alias("support"),
        )

    macro = [(a + b) / 2 for a, b in zip(zero_class[:3], one_class[:3])]
    weighted = [
        zero(a * zero_class[3] + b * one_class[3], total) for a, b in zip(zero_class[:3], one_class[:3])
    ]
    rows = F.array(
        row("0", zero_class[:3], zero_class[3]),
        row("1", one_class[:3], one_class[3]),
        row("accuracy", [accuracy] * 3, total),
        row("macro avg", macro, total),
        row("weighted avg", weighted, total),
    )
    return counts.select(F.inline(rows))


def regression_metrics(df, actual, predicted, by=()):
    """MAE, RMSE, MAPE over actuals above 1e-6 and the number of rows; one row, or one per group."""
    error = F.abs(F.col(actual) - F.col(predicted))
    share = F.when(F.col(actual) > 1e-6, error / F.col(actual))
    return df.groupBy(*by).agg(
        F.avg(error).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(share) * 100).alias("mape"),
        F.count(F.lit(1)).alias("rows"),
    )


def true_drops(scored, share=0.5):
    """Add true_drop (target below half the rolling mean) and predicted_drop (the anomaly flag)."""
    below = F.col("internet_target") < F.col("internet_roll_mean_24") * share
    return scored.withColumns(
        {
            "true_drop": F.coalesce(below, F.lit(False)).cast("int"),
            "predicted_drop": F.col("is_anomaly").cast("int"),
        }
    )
