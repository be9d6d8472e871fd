"""Cell geometry and neighbourhoods."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide.functions.columns import lattice_id, lattice_x, lattice_y
from gridtide.functions.ranks import exact_median
from gridtide.functions.sizes import broadcast_within, cut_lineage
from gridtide.schemas import LATTICE_WIDTH

STEP_MULTIPLIER = 1.5
NEIGHBORS = 8
#: Levels of the quadtree, each half as wide as the one before, and how many of them count as coarse.
LEVELS, COARSE = 24, 7


def lattice_edges(cells, width=LATTICE_WIDTH, height=None):
    """(grid_id, neighbor_id) pairs of the 8-neighbourhood on a row-by-row numbered lattice.

    Pure arithmetic on each id; without `height` the lattice is as tall as the ids need.
    """
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                        for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy])
    placed = cells.select(
        F.col("grid_id").cast("long").alias("grid_id"),
        lattice_x("grid_id", width).alias("x"),
        lattice_y("grid_id", width).alias("y"),
    )
    if height is None:
        height = placed.agg(F.max("y") + 1).scalar()
    moved = placed.withColumn("step", F.explode(offsets)).select(
        "grid_id", (F.col("x") + F.col("step.dx")).alias("x"), (F.col("y") + F.col("step.dy")).alias("y")
    )
    inside = F.col("x").between(0, width - 1) & (F.col("y") >= 0) & (F.col("y") < height)
    return moved.where(inside).select("grid_id", lattice_id("x", "y", width).alias("neighbor_id"))


def with_lattice_neighbor_mean(df, value, out, width=LATTICE_WIDTH, time="timestamp"):
    """Attach the mean of `value` over the 8 lattice neighbours at the same time, NULL when none is there.

    Every row offers its value to its own lattice row and the two adjacent ones; a range window over x
    then sees all nine places. That shuffles three narrow copies once, instead of eight plus a join,
    and a window group is one lattice row of one timestamp.
    """
    x = lattice_x("grid_id", width)
    y = lattice_y("grid_id", width)
    offered = df.select(
        F.col(time).alias("__time"),
        x.alias("__x"),
        F.col(value).alias("__value"),
        y.alias("__y"),
        F.struct(*df.columns).alias("__row"),
        F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("__dy"),
    ).select(
        "__time",
        "__x",
        "__value",
        (F.col("__y") + F.col("__dy")).alias("__y"),
        F.when(F.col("__dy") == 0, F.col("__row")).alias("__row"),
    )
    strip = Window.partitionBy("__time", "__y").orderBy("__x")
    left, right, here = strip.rangeBetween(-1, -1), strip.rangeBetween(1, 1), strip.rangeBetween(0, 0)
    above_below = F.when(F.col("__row").isNull(), F.col("__value"))
    sums = [F.sum("__value").over(left), F.sum("__value").over(right), F.sum(above_below).over(here)]
    counts = [F.count("__value").over(left), F.count("__value").over(right), F.count(above_below).over(here)]
    total = sum((F.coalesce(s, F.lit(0.0)) for s in sums[1:]), F.coalesce(sums[0], F.lit(0.0)))
    number = counts[0] + counts[1] + counts[2]
    return (
        offered.withColumn("__mean", F.try_divide(total, number))
        .where(F.col("__row").isNotNull())
        .select("__row.*", F.col("__mean").alias(out))
    )


def with_edge_neighbor_mean(df, edges, value, out, time="timestamp"):
    """Attach the mean of `value` over the neighbours listed in `edges` at the same time."""
    lookup = broadcast_within(edges.select("grid_id", "neighbor_id"))
    values = df.select(F.col("grid_id").alias("neighbor_id"), time, F.col(value).alias("__value"))
    means = values.join(lookup, "neighbor_id").groupBy("grid_id", time).agg(F.avg("__value").alias(out))
    return df.join(means, ["grid_id", time], "left")


def _cells(df, levels):
    """One row per point and level with the quadtree cell (cx, cy) of side extent / 2^level; `u`, `v` are places in the box."""
    scale = F.pow(F.lit(2.0), F.col("level"))
    spread = df.withColumn("level", levels)
    return spread.withColumns({"cx": F.floor(F.col("u") * scale), "cy": F.floor(F.col("v") * scale)})


def _shuffled(df):
    """Never broadcast in the next join: the planner takes rows multiplied by levels for as small as the file they come from."""
    return df.hint("merge")


def _levels(sites, k):
    """(grid_id, level): the finest level at which a site's cell holds more than k sites, 0 where none does.

    All levels are counted by one aggregate. The few cells of the coarse levels are looked up from a broadcast, so
    that no task meets all sites; the others are shuffled by cell.
    """
    cells = _cells(sites, F.explode(F.sequence(F.lit(1), F.lit(LEVELS)))).select("grid_id", "level", "cx", "cy")
    full = cells.groupBy("level", "cx", "cy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k).drop("n")
    coarse = F.col("level") <= COARSE  # at most 4^COARSE * 4 / 3 cells, whatever the number of points
    held = cells.where(coarse).join(F.broadcast(full.where(coarse)), ["level", "cx", "cy"])
    held = held.unionByName(cells.where(~coarse).join(_shuffled(full.where(~coarse)), ["level", "cx", "cy"]))
    return held.groupBy("grid_id").agg(F.max("level").alias("level"))


def nearest_cells(points, k, radius=None):
    """(grid_id, neighbor_id, distance): up to k nearest other points by (distance, id), within `radius`.

    Points are (grid_id, x, y); `radius` may be a number or a column of a one-row subquery. One lazy plan: a quadtree is
    counted at all levels at once, and a point searches the 5 x 5 cells around it at the finest level at which its own
    cell holds k others, for those lie within the cell's diagonal. Its cell one level below holds no more than k
    points, so a crowd is met by few points from outside and pairs up only among neighbours. With a radius no point
    searches cells larger than half of it needs. Of points that share a position only the first k+1 ids can ever be a
    neighbour, which keeps copies from pairing up as well.
    """
    points = points.select("grid_id", F.col("x").cast("double"), F.col("y").cast("double"))
    box = points.agg(
        F.struct(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side")).alias("b")
    ).scalar()
    extent = F.when(F.col("box.side") > 0, F.col("box.side")).otherwise(1.0)
    place = {"u": (F.col("x") - F.col("box.x0")) / extent, "v": (F.col("y") - F.col("box.y0")) / extent}
    spot = Window.partitionBy("x", "y")
    numbered = points.withColumns({"copy": F.row_number().over(spot.orderBy("grid_id")), "box": box}).withColumns(place)
    # A position with more than k points answers its own points; it is recognised by its copy number k + 1.
    several = F.max("copy").over(spot.orderBy("grid_id").rowsBetween(Window.currentRow, k)) > k
    numbered = numbered.withColumn("crowded", F.max(several & (F.col("copy") == 1)).over(spot.orderBy("grid_id").rowsBetween(Window.unboundedPreceding, 0)))
    sites = numbered.where(F.col("copy") <= k + 1)
    heads = sites.where("crowded").select("x", "y", F.col("grid_id").alias("neighbor_id"), F.col("copy").alias("place"))
    crowded = numbered.where("crowded").select("grid_id", "x", "y").join(_shuffled(heads), ["x", "y"])
    crowded = crowded.where(F.col("grid_id") != F.col("neighbor_id"))
    first_k = Window.partitionBy("grid_id").orderBy("place")
    found = crowded.withColumn("rank", F.row_number().over(first_k)).where(F.col("rank") <= k)
    found = found.select("grid_id", "neighbor_id", F.lit(0.0).alias("distance"))

    searching = sites.where(~F.col("crowded")).join(_shuffled(_levels(sites, k)), "grid_id", "left")
    level = F.coalesce(F.col("level"), F.lit(0))
    if radius is not None:
        radius = F.lit(radius)
        needed = F.floor(F.log2(F.col("box.side") / (radius * 0.5000001)))
        level = F.greatest(level, F.least(needed, F.lit(LEVELS)))
    around = F.array([F.lit(step) for step in range(-2, 3)])
    probes = _cells(searching, level.cast("int")).withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    probes = probes.select("grid_id", "x", "y", "level", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    others = _cells(sites, F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    others = others.select(F.col("grid_id").alias("neighbor_id"), F.col("x").alias("nx"), F.col("y").alias("ny"), "level", "cx", "cy")
    pairs = probes.join(_shuffled(others), ["level", "cx", "cy"]).where(F.col("grid_id") != F.col("neighbor_id"))
    distance = F.sqrt(F.pow(F.col("x") - F.col("nx"), 2) + F.pow(F.col("y") - F.col("ny"), 2))
    pairs = pairs.select("grid_id", "neighbor_id", distance.alias("distance"))
    if radius is not None:
        pairs = pairs.where(F.col("distance") <= radius)
    nearest = Window.partitionBy("grid_id").orderBy("distance", "neighbor_id")
    ranked = pairs.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return found.unionByName(ranked.drop("rank"))


def as_points(centroids):
    return centroids.select(
        "grid_id", F.col("centroid_longitude").alias("x"), F.col("centroid_latitude").alias("y")
    )


def nearest_distances(points):
    """Distance of every point to its nearest other point."""
    return nearest_cells(points, 1).select("grid_id", "distance")


def grid_step(points):
    """One row (value): the median nearest-neighbour distance."""
    return exact_median(cut_lineage(nearest_distances(points)), "distance")


def distance_edges(points, k=NEIGHBORS, multiplier=STEP_MULTIPLIER):
    """Neighbour pairs within `multiplier` grid steps, at most k per cell by (distance, id).

    The k nearest are searched and stored once; the grid step is the median of each cell's smallest distance among them.
    """
    near = cut_lineage(nearest_cells(points, k))
    step = exact_median(near.groupBy("grid_id").agg(F.min("distance").alias("distance")), "distance").scalar()
    return near.where(F.col("distance") <= step * multiplier)
