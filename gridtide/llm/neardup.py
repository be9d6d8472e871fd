"""Near-duplicate groups by circulant MinHash, banding and exact verification.

A document is the set of its five-word shingles. Two permutations make the whole signature: the first scatters
shingles over a circle of 2^32 positions, the second is shifted along the circle by one position per coordinate,
and a coordinate is the smallest value the set meets. Coordinates are cut into bands; documents with an equal band
share a bucket, and at a similarity of 0.75 a pair misses all 51 bands of 5 rows with a chance of one in a million.

Work is done on classes of equal word sequences. First every document is compared with one candidate, the smallest
center among its buckets, so a bucket of any size gives at most as many pairs as members. What is still open, the
documents of buckets that hold several components, goes through an exact join: shingles are ordered from rare to
common, two sets that reach the similarity share one of the first few shingles of both, and the places where they
meet bound what they can have in common. A passage that very many documents share stands at the end of that order
and pairs nobody by itself. Both steps confirm pairs on the full sets, and nothing is capped.
"""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from gridtide.functions.sizes import cut_lineage

SHINGLE_WORDS = 5
PERCENT = 75
BANDS, ROWS = 51, 5
BLOCK = 4096
#: Counters behind the order of shingles, a power of two; their number bounds what is broadcast.
COUNTERS = 1 << 19

SKETCH = "doc_id long, class_key binary, n_shingles long, bands array<long>"

# Independent odd factors for the words of a shingle: related factors would give permuted words equal sums.
_WEIGHTS = np.random.default_rng(2024).integers(0, 1 << 63, size=SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HASHES = {}


def _word_hash(word, most=200_000):
    value = _HASHES.get(word)
    if value is None:
        if len(_HASHES) >= most:
            _HASHES.clear()
        value = _HASHES[word] = xxhash.xxh3_64_intdigest(word)
    return value


def words_of(text):
    """Words of a text as bytes, A-Z in lower case."""
    return text.encode().lower().split() if text else []


def _mixed(values):
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def shingle_set(words, size=SHINGLE_WORDS):
    """Sorted distinct 64-bit hashes of the shingles; a shorter sequence is one shingle, no words are none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(_word_hash, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    count = len(words) - width + 1
    total = np.full(count, np.uint64(width), dtype=np.uint64)
    for i in range(width):
        total += hashes[i : i + count] * _WEIGHTS[i]
    return np.unique(_mixed(total))


def signature(shingles, coordinates=BANDS * ROWS):
    """Circulant MinHash: coordinate k is the smallest value of the second permutation, shifted by k, over the set."""
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    positions = (shingles >> np.uint64(32)).astype(np.uint32)  # the first permutation: hashes are scattered already
    smallest = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(positions), BLOCK):
        x = positions[None, at : at + BLOCK] - shifts
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(smallest, x.min(axis=1), out=smallest)
    return smallest


def band_keys(coordinates, bands=BANDS, rows=ROWS):
    """One signed 64-bit key per band, different between bands."""
    parts = coordinates.reshape(bands, rows).astype(np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(rows):
        keys = _mixed(keys + parts[:, i] * np.uint64(0x9E3779B97F4A7C15))
    return keys.view(np.int64)


def _batch(columns, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


_SKETCH_SCHEMA = pa.schema([("doc_id", pa.int64()), ("class_key", pa.binary()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sketched(batches):
    """Rows of SKETCH; the bands of a class come once per task."""
    seen = set()
    for batch in batches:
        ids, keys, sizes, bands = [], [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            words = words_of(text.as_py())
            key = xxhash.xxh3_128_digest(b" ".join(words)) if words else None
            ids.append(doc)
            keys.append(key)
            shingles = shingle_set(words)
            sizes.append(len(shingles))
            if key is None or doc is None or key in seen:
                bands.append(None)
            else:
                seen.add(key)
                bands.append(band_keys(signature(shingles)))
        yield _batch((ids, keys, sizes, bands), _SKETCH_SCHEMA)


def sketches(docs):
    """Per document its class, the number of shingles and, once per class and task, the band keys."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sketched, SKETCH)


_EDGE_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linked(percent):
    def confirm(batches):
        sets = {}

        def shingles(doc, text):
            if doc not in sets:
                if len(sets) >= 64:
                    sets.clear()
                sets[doc] = shingle_set(words_of(text))
            return sets[doc]

        for batch in batches:
            found = []
            for a, b, text_a, text_b in zip(*(batch.column(name) for name in ("a", "b", "text_a", "text_b"))):
                a, b = a.as_py(), b.as_py()
                # Two texts under one doc_id must not share a cached set.
                left, right = shingle_set(words_of(text_a.as_py())), shingles((b, hash(t := text_b.as_py())), t)
                common = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * common >= percent * (len(left) + len(right) - common):
                    found.append((a, b))
            yield _batch(list(zip(*found)) or ([], []), _EDGE_SCHEMA)

    return confirm


def confirmed(pairs, texts, percent=PERCENT):
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_linked(percent), "a long, b long").distinct()


def _summary(edges):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
    return row["n"], row["h"]


def components(edges):
    """(node, label) of every node with an edge: label is the smallest node it can reach.

    Large-star and small-star rounds over stored edges until nothing changes. A node with very many neighbours
    costs an aggregate with a map-side part and a join whose heavy side adaptive execution can split.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _summary(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut_lineage(large.where("a <> b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        small = small.select(F.greatest("e.b", "e.m").alias("a"), F.least("e.b", "e.m").alias("b")).where("a <> b").distinct()
        edges = cut_lineage(small)
        after = _summary(edges)
        if after == before:
            break
        before = after
    labels = edges.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return labels.union(roots).groupBy("node").agg(F.min("label").alias("label"))


def forest_labels(parents):
    """(node, label) from (a, b) with one smaller b per a: label is the root, found by doubling the step each round."""
    labels = cut_lineage(parents.select(F.col("a").alias("node"), F.col("b").alias("label"), F.lit(True).alias("moved")))
    while not labels.where("moved").isEmpty():
        up = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        step = labels.join(up, F.col("label") == F.col("via"), "left")
        labels = cut_lineage(step.select("node", F.coalesce("further", "label").alias("label"), F.col("further").isNotNull().alias("moved")))
    return labels.select("node", "label")


def first_candidates(members, percent):
    """(a, b): every member with the smallest center of its buckets whose size allows the similarity."""
    centers = members.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("c"))
    pairs = members.join(centers.select("bucket", F.col("c.id").alias("b"), F.col("c.n").alias("n_b")), "bucket").where("id <> b")
    fits = 100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b")
    return pairs.where(fits).groupBy(F.col("id").alias("a")).agg(F.min("b").alias("b"))


def open_documents(members, labels):
    """(doc_id, label) of the members of buckets that hold several components."""
    labelled = members.join(labels, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("label", "id").alias("label"))
    several = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    return labelled.join(several, "bucket").select(F.col("id").alias("doc_id"), "label").distinct()


_COUNT_SCHEMA = pa.schema([("counter", pa.int32()), ("n", pa.int64())])
_PREFIX_SCHEMA = pa.schema(
    [("shingle", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("leads", pa.bool_())]
)


def _counters(shingles):
    return (shingles >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _counted(batches):
    total = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for text in batch.column("text"):
            total += np.bincount(_counters(shingle_set(words_of(text.as_py()))), minlength=COUNTERS)
    used = np.flatnonzero(total)
    yield _batch((used, total[used]), _COUNT_SCHEMA)


def _packed(batches):
    """All rows of a task as one row of two byte strings."""
    table = pa.Table.from_batches(batches, _COUNT_SCHEMA)
    columns = [[np.ascontiguousarray(table.column(name).to_numpy()).tobytes()] for name in ("counter", "n")]
    yield pa.RecordBatch.from_arrays([pa.array(column, pa.binary()) for column in columns], ["counter", "n"])


def shingle_order(texts):
    """How often shingles of each counter occur: an array of fixed length that ranks shingles from rare to common.

    The driver gets 12 bytes per counter at most, packed by the tasks that summed them.
    """
    counted = texts.select("text").mapInArrow(_counted, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    order = np.zeros(COUNTERS, dtype=np.int64)
    for row in counted.mapInArrow(_packed, "counter binary, n binary").toLocalIterator():
        order[np.frombuffer(row["counter"], dtype=np.int32)] = np.frombuffer(row["n"], dtype=np.int64)
    return order


def prefixes(texts, order, percent):
    """The first shingles of every set in the order: enough to meet any set that reaches the similarity.

    Of a set of n shingles, partners of any size meet the first n - ceil(p n) + 1, and partners of at least its own
    size meet those that `leads` marks, the first n - ceil(2 p n / (1 + p)) + 1.
    """

    def emit(batches):
        for batch in batches:
            parts = []
            for doc, label, text in zip(*(batch.column(name) for name in ("doc_id", "label", "text"))):
                shingles = shingle_set(words_of(text.as_py()))
                n = len(shingles)
                if not n:
                    continue
                ranked = shingles[np.lexsort((shingles, order[_counters(shingles)]))]
                size = n + (-percent * n) // 100 + 1
                lead = n + (-2 * percent * n) // (100 + percent) + 1
                rows = np.arange(size)
                parts.append((ranked[:size].view(np.int64), np.full(size, doc.as_py()), np.full(size, label.as_py()), np.full(size, n), rows, rows < lead))
            columns = [np.concatenate(column) for column in zip(*parts)] or [()] * len(_PREFIX_SCHEMA)
            yield _batch(columns, _PREFIX_SCHEMA)

    return texts.select("doc_id", "label", "text").mapInArrow(emit, "shingle long, id long, label long, n int, place int, leads boolean")


def exact_candidates(texts, percent):
    """(a, b): all pairs of documents of different labels that can reach the similarity, and few others."""
    rows = cut_lineage(prefixes(texts, shingle_order(texts), percent))
    several = rows.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("shingle")
    rows = cut_lineage(rows.join(several, "shingle"))
    # Sets of similar size are in the band of the smaller one or in the next.
    band = F.floor(F.log(F.col("n")) / math.log((100 / percent)) + 1e-9) if percent < 100 else F.col("n")
    rows = rows.withColumn("band", band.cast("int"))
    small = rows.where("leads").drop("leads").withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    large = rows.select("shingle", "band", *[F.col(name).alias(f"{name}_b") for name in ("id", "label", "n", "place")])
    # What can be common depends on sizes and places alone: profiles of components meet first, and the documents of
    # those that can be similar after them. Documents of one component never meet each other.
    mine, theirs = ["label", "n", "place"], ["label_b", "n_b", "place_b"]
    most = F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b"))
    meet = small.select("shingle", "band", *mine).distinct().join(large.select("shingle", "band", *theirs).distinct(), ["shingle", "band"]).where(
        (F.col("label") != F.col("label_b"))
        & (F.col("n") <= F.col("n_b"))
        & (100 * F.col("n") >= percent * F.col("n_b"))
        & (most * (100 + percent) >= percent * (F.col("n") + F.col("n_b")))
    )
    pairs = small.join(meet, ["shingle", "band", *mine]).join(large, ["shingle", "band", *theirs])
    return pairs.select(F.greatest("id", "id_b").alias("a"), F.least("id", "id_b").alias("b")).distinct()


def near_duplicates(docs, percent=PERCENT):
    """Per document: doc_id, n_shingles, component_id, kept.

    Empty and null texts have no shingles and are their own component. A null doc_id cannot name a component: such
    rows link with nothing, get a null component_id and are kept. Rows that share a doc_id are one node. Repeated
    rows give repeated rows, extra columns are ignored, an empty table gives no rows.
    """
    sketched = cut_lineage(sketches(docs))
    named = sketched.where(F.col("doc_id").isNotNull() & F.col("class_key").isNotNull())
    classes = named.groupBy("class_key").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.first("bands", True).alias("bands"))
    classes = cut_lineage(classes)
    spread = classes.select(F.explode("bands").alias("bucket"), "id", "n")
    shared = spread.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("bucket")
    members = cut_lineage(spread.join(shared, "bucket"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = cut_lineage(own.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"))

    labels = forest_labels(confirmed(first_candidates(members, percent), texts, percent))
    still = open_documents(members, labels).join(texts, "doc_id")
    still = cut_lineage(still)
    links = cut_lineage(confirmed(exact_candidates(still, percent), texts, percent))
    if not links.isEmpty():
        known = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = components(known.union(links))
    labels = cut_lineage(labels)
    owners = classes.join(labels, F.col("id") == F.col("node"), "left").select("class_key", F.coalesce("label", "id").alias("component"))
    found = sketched.select("doc_id", "class_key", "n_shingles").join(owners, "class_key", "left")
    component = F.when(F.col("class_key").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs, percent=PERCENT):
    """Documents without near-duplicates: of every component the document with the smallest doc_id stays.

    Rows that repeat a kept doc_id come once; rows with a null doc_id all stay.
    """
    kept = near_duplicates(docs, percent).where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    kinds = [field.name for field in docs.schema if field.dataType.typeName() != "map"]
    rows = docs.join(kept, "doc_id", "left_semi").select("doc_id", F.struct(*docs.columns).alias("row"), F.xxhash64(*kinds).alias("order"))
    first = rows.groupBy("doc_id").agg(F.min_by("row", "order").alias("row"))  # of rows that differ under one doc_id the same one on every run
    return first.select("row.*").union(docs.where(F.col("doc_id").isNull()))
