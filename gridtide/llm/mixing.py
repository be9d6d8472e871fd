"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every source has a target in words. A document's expected number of copies is its source's target over its
source's size, tilted by an optional document weight; the whole part is taken for certain, and the fraction is the
inclusion chance of one more copy. Documents of a source are ordered by the odds of a random number over the odds
of their inclusion chance, and the sample is the front of that order that fills what the certain copies leave of
the target. Behind the document that would exceed it the order goes on with those that still fit, and the last place
goes to the document whose size comes nearest to what is left. The random number is a hash of document and seed, so reruns agree.

No source is ever sorted as a whole: its order is cut into pieces by value, word sums per piece locate the piece in
which the target is reached, that piece is cut again, and only rows of the last small piece are ordered. The cut is
one sampling key per source, so that selecting documents is one comparison and needs no join by document.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide.functions.sizes import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3.0
PIECES = 4096
SEED = 20_240_607


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_unit(seed=SEED):
    """A number strictly between 0 and 1 from document id, text and seed."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def numbered_sources(sizes):
    """`sizes` (source, source_size) with each source's rank by code point, null last, from 0.

    Sources are range partitioned and stored; ranks are positions inside a piece plus the sizes of the pieces
    before it, so no task sees all sources.
    """
    pieces = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("piece", F.spark_partition_id())
    pieces = cut_lineage(pieces)
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # one row per piece
    starts = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).select("piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("piece").orderBy(F.col("source").asc_nulls_last())
    ranked = pieces.withColumn("at", F.row_number().over(inside) - 1).join(starts, "piece")
    return ranked.select("source", "source_size", (F.col("at") + F.col("start")).alias("rank"))


def with_targets(sources, weights=WEIGHTS, most=MOST_COPIES):
    """`sources` with the column target: shares of the total by weight, none above `most` times its source.

    A source at its limit keeps it and the excess is shared again by weight, until none is above. Each turn is one
    aggregate over the sources that yields three numbers; the number of turns is at most the number of sources.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = cut_lineage(sources.select("source", "source_size", weight.alias("weight")))
    limit = F.col("source_size") * F.lit(float(most))
    share, full = 0.0, -1
    total = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    while True:
        above = F.col("weight") * F.lit(share) >= limit
        row = sources.agg(
            F.count(F.when(above, 1)).alias("full"),
            F.sum(F.when(above, limit)).alias("fixed"),
            F.sum(F.when(~above, F.col("weight"))).alias("weight"),
        ).first()
        if row["full"] == full or not row["weight"]:
            break
        full = row["full"]
        share = (total - (row["fixed"] or 0.0)) / row["weight"]
    return sources.select("source", "source_size", F.least(F.col("weight") * F.lit(share), limit).alias("target"))


def keyed(docs, weight=None, seed=SEED):
    """Docs with size (words), unit (the random number), text_hash and tilt (the weight, 1 without one)."""
    tilt = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    return docs.withColumns({"size": word_count(F.col("text")), "unit": random_unit(seed), "text_hash": F.xxhash64("text"), "tilt": tilt})


def _copies(most):
    return F.least(F.col("ratio") * F.col("tilt"), F.lit(float(most)))


def _order(most):
    """Where a document stands in the order of its source, from 0 to 1; null where no further copy is possible.

    q = (u / (1 - u)) / (p / (1 - p)) is the Pareto ranking variable for inclusion chance p; q / (1 + q) has the
    same order and a bounded range.
    """
    chance = _copies(most) - F.floor(_copies(most))
    odds = (F.col("unit") / (1 - F.col("unit"))) * ((1 - chance) / chance)
    return F.when((chance > 0) & (F.col("size") > 0), odds / (1 + odds))


def _same(left, right):
    return F.col(left).eqNullSafe(F.col(right))


def _crossed(rows, piece):
    """(s, the piece of each source in which the running sum of words reaches `rest`, what is left of `rest` there)."""
    running = Window.partitionBy("source").orderBy(piece).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("source", piece).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    sums = sums.withColumn("upto", F.sum("words").over(running))
    hit = sums.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
    return hit.select(F.col("source").alias("s"), F.col(piece).alias("hit"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))


_KEY = ("order", "doc_id", "text_hash")


def _front(opened, rest, pieces):
    """(s, cut): the last key of every source up to which the running sum of words is within `rest` (s, rest)."""
    opened = opened.join(rest, _same("source", "s")).where("rest > 0").drop("s")

    def inside(part, hit, piece):
        return part.drop("rest").join(hit, _same("source", "s") & (F.col(piece) == F.col("hit"))).withColumnRenamed("left", "rest").drop("s", "hit")

    within = cut_lineage(inside(opened, _crossed(opened, "outer"), "outer"))
    last = cut_lineage(inside(within, _crossed(within, "inner"), "inner"))  # about size / pieces^2 rows of each source
    by_key = Window.partitionBy("source").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, 0)
    ranked = last.withColumn("upto", F.sum("size").over(by_key))
    start = (F.col("outer") + F.col("inner") / F.lit(pieces)) / F.lit(pieces)
    nothing = F.lit(None).cast("long")
    before = F.struct(start.alias("order"), nothing.alias("doc_id"), nothing.alias("text_hash"))  # all before this piece
    key = F.when(F.col("upto") <= F.col("rest"), F.struct(*_KEY))
    cuts = ranked.groupBy("source").agg(F.coalesce(F.max(key), F.min(before)).alias("cut"))
    everything = F.struct(F.lit(2.0).alias("order"), nothing.alias("doc_id"), nothing.alias("text_hash"))
    return rest.join(cuts, _same("s", "source"), "left").select("s", F.when(F.col("rest") > 0, F.coalesce("cut", everything)).alias("cut"))


def _taken_from(opened, plan):
    """Opened rows with the plan of their source and whether a front takes them."""
    joined = opened.join(plan, _same("source", "s")).drop("s")
    key = F.struct(*_KEY)
    front = F.coalesce(key <= F.col("cut"), F.lit(False)) | F.coalesce((F.col("each") <= F.col("fitting")) & (key <= F.col("filled")), F.lit(False))
    return joined.withColumn("front", front)


def _left(opened, plan):
    """(s, left): the words that the fronts of every source leave of `rest`."""
    taken = F.coalesce(F.sum(F.when(F.col("front"), F.col("size"))), F.lit(0))
    return _taken_from(opened, plan).groupBy(F.col("source").alias("s")).agg((F.first("rest") - taken).alias("left"))


def sampling_plan(rows, weights=WEIGHTS, most=MOST_COPIES, pieces=PIECES):
    """(plan_source, source_size, target, ratio, cut, fitting, filled, edge) from stored `keyed` rows.

    A document takes floor(ratio * tilt) copies, at most `most`, and one more if its key (order, doc_id, text_hash) is
    in the front of the order. The first front ends (`cut`) before the document that exceeds the target. From there
    it goes on with the documents of at most `fitting` words, what was left, up to `filled`. What is left then goes to
    one document, `edge`, whose size comes nearest. Nulls select none. `pieces` is a power of two, so piece numbers are
    exact.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("tilt")).alias("tilted"))
    sizes = cut_lineage(sizes)
    targets = with_targets(numbered_sources(sizes.select("source", "source_size")), weights, most).withColumnRenamed("source", "s")
    ratio = F.when(F.col("tilted") > 0, F.round(F.col("target") / F.col("tilted"), 12)).otherwise(0.0)
    ratios = sizes.select("source", "tilted").join(targets, _same("source", "s"))
    ratios = cut_lineage(ratios.select("s", "source_size", "target", ratio.alias("ratio")))

    opened = rows.join(ratios, _same("source", "s")).drop("s")
    certain = opened.groupBy("source").agg(F.sum(F.col("size") * F.floor(_copies(most))).alias("certain"), F.first("target").alias("target"))
    rest = certain.select(F.col("source").alias("s"), F.greatest(F.col("target") - F.col("certain"), F.lit(0.0)).alias("rest"))
    rest = cut_lineage(rest)
    # Rows that repeat a document stand at one place of the order and are taken together.
    opened = opened.withColumn("order", _order(most)).where(F.col("order").isNotNull()).groupBy("source", *_KEY)
    opened = opened.agg(F.sum("size").alias("size"), F.first("size").alias("each"))
    scaled = F.col("order") * pieces
    opened = cut_lineage(
        opened.withColumns({"outer": F.floor(scaled).cast("int"), "inner": F.floor((scaled - F.floor(scaled)) * pieces).cast("int")})
    )

    none, number = F.lit(None), F.lit(None).cast("double")
    plan = rest.join(_front(opened, rest, pieces).withColumnRenamed("s", "t"), _same("s", "t")).drop("t")
    plan = cut_lineage(plan.select("s", "rest", "cut", number.alias("fitting"), none.cast(plan.schema["cut"].dataType).alias("filled")))
    left = cut_lineage(_left(opened, plan))
    behind = _taken_from(opened, plan).where(~F.col("front")).select("source", *_KEY, "size", "each", "outer", "inner")
    behind = behind.join(left, _same("source", "s")).where(F.col("each") <= F.col("left")).drop("s", "left")
    filled = _front(behind, left.withColumnRenamed("left", "rest"), pieces).select(F.col("s").alias("t"), F.col("cut").alias("filled"))
    plan = plan.drop("fitting", "filled").join(filled, _same("s", "t"), "left").drop("t")
    plan = plan.join(left.withColumnRenamed("s", "t"), _same("s", "t"), "left").select("s", "rest", "cut", F.col("left").alias("fitting"), "filled")
    plan = cut_lineage(plan)

    left = cut_lineage(_left(opened, plan))
    behind = _taken_from(opened, plan).where(~F.col("front")).join(left, _same("source", "s"))
    off = F.abs(F.col("size") - F.col("left"))
    edge = behind.where(off < F.col("left")).groupBy(F.col("source").alias("t")).agg(F.min_by(F.struct(*_KEY), F.struct(off.alias("off"), *_KEY)).alias("edge"))
    plan = ratios.join(plan.withColumnRenamed("s", "r"), _same("s", "r"), "left").join(edge, _same("s", "t"), "left")
    return cut_lineage(plan.select(F.col("s").alias("plan_source"), "source_size", "target", "ratio", "cut", "fitting", "filled", "edge"))


def with_copies(rows, plan, most=MOST_COPIES):
    """`keyed` rows with source_size, target and copies, the number of times the mix takes the document."""
    joined = rows.join(plan, _same("source", "plan_source"))
    key = F.struct(_order(most).alias("order"), F.col("doc_id").cast("long").alias("doc_id"), "text_hash")
    fills = (F.col("size") <= F.col("fitting")) & (key <= F.col("filled"))
    extra = F.coalesce(key <= F.col("cut"), F.lit(False)) | F.coalesce(fills, F.lit(False)) | (F.col("edge").isNotNull() & key.eqNullSafe(F.col("edge")))
    more = (extra & _order(most).isNotNull()).cast("int")
    return joined.withColumn("copies", (F.floor(_copies(most)) + more).cast("int")).drop("plan_source", "ratio", "cut", "fitting", "filled", "edge")


def mix(docs, weights=WEIGHTS, most=MOST_COPIES, weight=None, seed=SEED):
    """Per document: doc_id, source, size, source_size, target, copies, taken.

    Null text has size 0 and takes nothing; null source is a source of its own and ranks last. Rows that repeat
    both doc_id and text share one key and are taken together. Extra columns are ignored, except the optional
    `weight` column, whose nulls count as 0. An empty table gives no rows.
    """
    names = ["doc_id", "source", "text"] + ([weight] if weight else [])
    rows = cut_lineage(keyed(docs.select(*names).withColumn("doc_id", F.col("doc_id").cast("long")), weight, seed).drop("text"))
    found = with_copies(rows, sampling_plan(rows, weights, most), most)
    return found.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs, weights=WEIGHTS, most=MOST_COPIES, seed=SEED):
    """The documents the mix takes, each as often as it takes them, with their columns."""
    names = docs.columns
    rows = keyed(docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), None, seed).drop("text")
    plan = sampling_plan(cut_lineage(rows.drop("row")), weights, most)
    taken = with_copies(rows, plan, most).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
