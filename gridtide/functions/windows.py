"""Window expressions over the hourly series of a cell.

The hourly table has one row per cell and hour, so a window partitioned by cell holds at most one row
per hour of history and one partitioned by cell and date at most one row per hour of that day.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide.functions.columns import col


def series(*keys, order="timestamp"):
    return Window.partitionBy(*keys).orderBy(order)


def trailing(window, rows, gap=0):
    """Frame of `rows` rows that ends `gap` rows before the current one (gap 0 includes it)."""
    return window.rowsBetween(-(gap + rows - 1), -gap)


def full_frame(function, value, window, rows):
    """Aggregate over the last `rows` rows including this one, NULL until the frame is full."""
    frame = trailing(window, rows)
    return F.when(F.count(col(value)).over(frame) == rows, function(col(value)).over(frame))


def leave_one_out_median(df, value, keys, out="loo_median"):
    """Attach the median of the other rows of the group to every row.

    Removing one row from a sorted group of n leaves a median that depends only on the middle order
    statistics, so three conditional maxima over the group are enough and no list is collected.
    NULL for groups of one row.
    """
    group = Window.partitionBy(*keys)
    rank, others, low = F.col("__rank"), F.col("__others"), F.col("__low")
    df = df.withColumns(
        {
            "__rank": F.row_number().over(group.orderBy(value)) - 1,
            "__others": F.count(F.lit(1)).over(group) - 1,
        }
    ).withColumn("__low", F.floor((others - 1) / 2).cast("int"))
    middle = {
        f"__middle{step}": F.max(F.when(rank == low + step, F.col(value))).over(group) for step in range(3)
    }
    df = df.withColumns(middle)
    # A row at or below a kept position is the one left out, which shifts that position up by one.
    lower = F.when(rank <= low, F.col("__middle1")).otherwise(F.col("__middle0"))
    upper = F.when(rank <= low + 1, F.col("__middle2")).otherwise(F.col("__middle1"))
    median = F.when(others % 2 == 1, lower).when(others > 0, (lower + upper) / 2.0)
    return df.withColumn(out, median).drop("__rank", "__others", "__low", *middle)


def with_merged_halves(df, value, window, half, gap=0, prefix="__w_"):
    """Statistics over the last 2 * half rows that end `gap` rows before the current one.

    Adds <prefix>n, mean, spread (sample deviation), top (maximum), active (rows above 0), recent_mean and
    before_mean. Only the later half is aggregated row by row: the earlier half is the same aggregate
    `half` rows before, and the two are merged. Columns nobody uses are pruned by the optimizer.
    """
    value = col(value)
    frame = trailing(window, half, gap)
    aggregates = {
        "n": F.count(value),
        "mean": F.avg(value),
        "top": F.max(value),
        "active": F.count_if(value > 0),
        "variance": F.var_pop(value),
    }
    recent = {f"{prefix}r_{name}": aggregate.over(frame) for name, aggregate in aggregates.items()}
    before = {f"{prefix}b_{name}": F.lag(f"{prefix}r_{name}", half).over(window) for name in aggregates}

    def both(name):
        zero = F.lit(0) if name in ("n", "active") else F.lit(0.0)
        return [F.coalesce(F.col(f"{prefix}{part}_{name}"), zero) for part in ("r", "b")]

    (n_r, n_b), (mean_r, mean_b), (var_r, var_b) = both("n"), both("mean"), both("variance")
    n = n_r + n_b
    between = F.try_divide((mean_r - mean_b) * (mean_r - mean_b) * n_r * n_b, n)
    squares = var_r * n_r + var_b * n_b + F.coalesce(between, F.lit(0.0))
    merged = {
        f"{prefix}n": n,
        f"{prefix}mean": F.try_divide(mean_r * n_r + mean_b * n_b, n),
        f"{prefix}spread": F.when(n > 1, F.sqrt(F.try_divide(squares, n - 1))),
        f"{prefix}top": F.greatest(f"{prefix}r_top", f"{prefix}b_top"),
        f"{prefix}active": F.when(n > 0, both("active")[0] + both("active")[1]),
        f"{prefix}recent_mean": F.col(f"{prefix}r_mean"),
        f"{prefix}before_mean": F.col(f"{prefix}b_mean"),
    }
    return df.withColumns(recent).withColumns(before).withColumns(merged).drop(*recent, *before)
