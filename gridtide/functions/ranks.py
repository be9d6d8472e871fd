"""Order statistics and running counts that never sort a whole table in one task."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide.functions.sizes import cut_lineage

#: Steps of the grid of quantiles that each round of a sketch yields.
STEPS = 1000


def _grid(value, accuracy):
    """Sketched quantiles of `value` at 0, 1/STEPS, ..., 1; nulls are left out."""
    shares = F.lit(",".join(str(i / STEPS) for i in range(STEPS + 1)))  # one literal keeps the plan small
    return F.percentile_approx(value, F.split(shares, ",").cast("array<double>"), F.lit(accuracy))


def _around(grid, first, second, n):
    """(low, high): values of a grid over n rows that enclose the 0-based ranks `first` to `second`.

    The sketch is off by at most a tenth of a step; two steps to both sides leave room for that and for rounding.
    """

    def at(rank, by):
        step = F.floor(rank / n * STEPS) + by
        return F.element_at(grid, (F.least(F.greatest(step, F.lit(0)), F.lit(STEPS)) + 1).cast("int"))

    return at(first, -2), at(second, 3)


def exact_percentile(df, column, fraction, accuracy=10 * STEPS):
    """One row (value): percentile with linear interpolation between the two nearest ranks; null without values.

    A plan of three aggregates over the column, each behind the result of the one before as a scalar subquery, and no
    job until the result is read. Two mergeable sketches enclose the wanted ranks, first among all values, then
    among the enclosed ones; the values left, about one in 40,000, are counted one by one below running sums. Values
    that very many rows share are one count. Should the ranks lie outside, the query fails: nothing is approximated.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    v, s = F.col("v"), lambda name: F.col(f"s.{name}")
    position = F.lit(float(fraction)) * (F.col("n") - 1)
    ranked = values.agg(F.count("v").alias("n"), _grid(v, accuracy).alias("grid"))
    ranked = ranked.withColumns({"position": position, "first": F.floor(position), "second": F.ceil(position)})
    low, high = _around(F.col("grid"), F.col("first"), F.col("second"), F.col("n"))
    outer = ranked.select(F.struct("n", "position", "first", "second", low.alias("low"), high.alias("high")).alias("s")).scalar()

    # Every round has the result of the one before as a column `s`, so the plan holds it once.
    enclosed = v >= s("low")
    inside = values.withColumn("s", outer).where(v <= s("high")).agg(
        F.first("s").alias("s"), F.count_if(~enclosed).alias("below"), F.count_if(enclosed).alias("inside"), _grid(F.when(enclosed, v), accuracy).alias("grid")
    )
    low, high = _around(F.col("grid"), s("first") - F.col("below"), s("second") - F.col("below"), F.col("inside"))
    inner = inside.select(F.struct("s.n", "s.position", "s.first", "s.second", low.alias("low"), high.alias("high")).alias("s")).scalar()

    # All values below the enclosed ones are one group, that of the null key, which comes first.
    kept = values.withColumn("s", inner).where(v <= s("high"))
    counted = kept.groupBy(F.when(enclosed, v).alias("key")).agg(F.count(F.lit(1)).alias("copies"))
    upto = Window.orderBy(F.col("key").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)  # few values are left
    summed = counted.withColumn("upto", F.sum("copies").over(upto)).withColumn("s", inner)
    found = summed.agg(
        F.first("s").alias("s"), F.count_if(F.col("key").isNull() & (F.col("upto") > s("first"))).alias("missed"), F.max("upto").alias("upto"),
        *[F.min(F.when(F.col("upto") > s(rank), F.col("key"))).alias(f"at_{rank}") for rank in ("first", "second")],
    )
    missed = (F.col("missed") > 0) | (F.col("upto") <= s("second"))
    between = F.col("at_first") + (F.col("at_second") - F.col("at_first")) * (s("position") - s("first"))
    error = F.raise_error(F.lit("percentile bracket misses the wanted rank")).cast("double")
    return found.select(F.when(missed, error).otherwise(between).alias("value"))


def exact_median(df, column):
    return exact_percentile(df, column, 0.5)


def counts_from_top(df, score, label):
    """Per distinct score: positives and negatives at or above it.

    Scores are counted first, then range-partitioned into pieces of similar size and stored, so that the
    pieces stay the same for both uses. Only the totals of the pieces pass through one ordered window;
    the running counts inside a piece are computed piece by piece.
    """
    per_score = (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(score).alias("score"))
        .agg(
            F.count_if(F.col(label) == 1).alias("positives"),
            F.count_if(F.col(label) == 0).alias("negatives"),
        )
    )
    ranged = per_score.repartitionByRange(F.col("score").desc()).withColumn("piece", F.spark_partition_id())
    pieces = cut_lineage(ranged)
    above = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy("piece")
        .agg(F.sum("positives").alias("p"), F.sum("negatives").alias("q"))
        .select(
            "piece",
            F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p_above"),
            F.coalesce(F.sum("q").over(above), F.lit(0)).alias("q_above"),
        )
    )
    inside = (
        Window.partitionBy("piece").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    )
    # offsets has one row per shuffle partition, which bounds the broadcast.
    return pieces.join(F.broadcast(offsets), "piece").select(
        "score",
        "positives",
        "negatives",
        (F.col("p_above") + F.sum("positives").over(inside)).alias("true_positives"),
        (F.col("q_above") + F.sum("negatives").over(inside)).alias("false_positives"),
    )
