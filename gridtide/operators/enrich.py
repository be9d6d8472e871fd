"""Joins of activity with the cell dimension."""

from pyspark.sql import functions as F

from gridtide.functions.columns import ratio_or_zero
from gridtide.functions.ranks import exact_percentile
from gridtide.functions.sizes import broadcast_within
from gridtide.operators.clean import on_weekday_hour
from gridtide.operators.hourly import top_cells
from gridtide.schemas import ENRICHED_COLUMNS


def with_geometry(hourly, reference):
    """Left join with the cell geometry; broadcast while its measured size allows, else shuffled."""
    return hourly.join(broadcast_within(reference), "grid_id", "left")


def with_geometry_shuffled(hourly, reference):
    """The same join as a sort-merge join, for references that do not fit in memory."""
    return hourly.join(reference.hint("merge"), "grid_id", "left")


def enriched_columns(enriched):
    """Projection of the stored enriched table; the daily columns are dropped."""
    return enriched.select(*ENRICHED_COLUMNS)


def top_cells_with_geometry(hourly, reference, n=10):
    """Busiest cells with their geometry: aggregate first, then look up only the n cells."""
    top = top_cells(hourly, n)
    # Both broadcasts hold at most n rows: the ranking itself and the geometries of its cells.
    shapes = reference.join(F.broadcast(top.select("grid_id")), "grid_id", "left_semi")
    return top.join(F.broadcast(shapes), "grid_id", "left")


def cells_with_activity(cells, activity):
    """Every cell with its activity, 0 where it had none."""
    joined = cells.join(activity.select("grid_id", "activity"), "grid_id", "left")
    return joined.withColumn("activity", F.coalesce("activity", F.lit(0.0)))


def map_slice(hourly, reference, weekday, hour, cap=0.98):
    """Activity of one weekday hour on the map: inner join with geometry and a capped colour value."""
    sliced = on_weekday_hour(hourly, weekday, hour)
    located = sliced.join(broadcast_within(reference), "grid_id", "inner")
    cutoff = exact_percentile(located.select("total_activity"), "total_activity", cap)
    return located.withColumn("cutoff", cutoff.scalar()).withColumn(
        "capped_activity", F.least("total_activity", "cutoff")
    )


def with_cluster(df, clusters):
    """Attach the cluster label of the cell, -1 where it has none."""
    joined = df.join(broadcast_within(clusters.select("grid_id", "cell_cluster")), "grid_id", "left")
    return joined.withColumn("cell_cluster", F.coalesce("cell_cluster", F.lit(-1)).cast("int"))


def relative_activity(cells):
    """Add the share of the busiest cell and keep the scale defined when all are below one."""
    busiest = cells.agg(F.greatest(F.max("activity"), F.lit(1.0)).alias("m"))
    return cells.withColumn("relative", ratio_or_zero(F.col("activity"), busiest.scalar()))
