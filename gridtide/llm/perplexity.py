"""Quality filter by an interpolated modified Kneser-Ney model of characters.

The model is trained on all trusted text (documents labelled good and not toxic, without a held-back fifth) and
gives every document its perplexity. Thresholds are quantiles of the held-back trusted documents, per language,
drawn towards the quantile over all languages as far as a language has few of them, and wider for shorter texts.

To a window of four characters a repeated word or line looks like clean text. Therefore a document's novelty, the
share of its longer n-grams that it has not shown before, has thresholds too: from all trusted documents, for they
do not depend on the model.

Text is moved as packets: documents of one block (a hash of doc_id) packed and compressed together, which keeps
all their columns and makes a shuffle a fraction of the text. One pass brings packets and labels of a block
together and counts distinct n-grams; a second brings packets and the scores of the block's n-grams together. In
between, counts, continuation counts, contexts and back-off are joins and aggregates over tables sharded by
n-gram; they hold every distinct n-gram of the corpus, and what a block receives is what its own text needs, so
nothing is broadcast and no task sees the whole model.
"""

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridtide.functions.sizes import cut_lineage

ORDER = 4
BLOCK_BYTES = 24 << 20
#: One in so many trusted documents sets thresholds instead of training.
HELD_BACK = 5
QUANTILE = 0.995
#: Held-back documents that a median needs at least, and as how many the quantile over all languages counts.
LEAST_HELD, PRIOR = 5, 200
#: Novelty is the share of distinct n-grams of so many characters in stretches of so many, then of 16 times as many.
NOVEL, STRETCH, WIDER = 8, 1 << 12, 16
SLICE = 1 << 19  # characters handled at once
PAD = 2  # code point of the mark in front of a text; real ones are replaced
HOLE = 0xFFFD


# ---- packets ------------------------------------------------------------------------------------------------


def _own_name(names, name):
    """A column name that the table does not use."""
    while name in names:
        name = "_" + name
    return name


def block_count(docs, block_bytes=BLOCK_BYTES):
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"]
    return max(1, -(-(size or 0) // block_bytes))


def packets(docs, blocks):
    """(block, payload): the rows of a batch that share a block, with all columns, compressed together."""
    name = _own_name(docs.columns, "block")
    key = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))), F.lit(blocks)).cast("int")

    def packed(batches):
        compressor = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            numbers = batch.column(name).to_numpy(zero_copy_only=False)
            rows = pa.Table.from_batches([batch]).drop_columns([name])
            order = np.argsort(numbers, kind="stable")
            ends = np.flatnonzero(np.append(np.diff(numbers[order]), 1)) + 1
            found, payloads = [], []
            for start, end in zip([0, *ends[:-1]], ends):
                part = rows.take(pa.array(order[start:end])).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_table(part)
                found.append(int(numbers[order[start]]))
                payloads.append(compressor.compress(sink.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(payloads, pa.binary())], ["block", "payload"])

    return docs.withColumn(name, key).mapInArrow(packed, "block int, payload binary")


def unpacked(payload):
    return pa.ipc.open_stream(zstandard.decompress(payload)).read_all()


# ---- n-grams ------------------------------------------------------------------------------------------------


def code_points(texts):
    """(codes, ends): code points of all texts, each behind ORDER - 1 marks, and where each text ends."""
    pad = chr(PAD) * (ORDER - 1)
    joined = "".join(pad + text for text in texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).copy()
    sizes = np.fromiter((len(text) for text in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes + ORDER - 1)
    codes[codes == 0] = HOLE
    marks = np.zeros(len(codes), dtype=bool)
    for i in range(ORDER - 1):
        marks[ends - sizes - 1 - i] = True
    codes[(codes == PAD) & ~marks] = HOLE
    return codes, ends, sizes


def keys(codes):
    """One 64-bit key per n-gram that ends at each place from ORDER - 1 on: a mix of its code points."""
    count = len(codes) - ORDER + 1
    if count < 1:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for i in range(ORDER):
        total = (total + codes[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def _slices(texts):
    """Lists of texts of about SLICE characters; a longer text is a list of its own."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > SLICE:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _text_places(ends, sizes, total):
    """Which n-gram places end on a character of a text and not on a mark."""
    inside = np.zeros(total + 1, dtype=np.int32)
    np.add.at(inside, ends - sizes, 1)
    np.add.at(inside, ends, -1)
    return (np.cumsum(inside[:-1]) > 0)[ORDER - 1 :]


def gram_table(texts):
    """(keys, n-grams as rows of code points, counts) of the distinct n-grams of some texts."""
    found = []
    for part in _slices(texts):
        codes, ends, sizes = code_points(part)
        places = _text_places(ends, sizes, len(codes))
        own = keys(codes)[places]
        distinct, first, counts = np.unique(own, return_index=True, return_counts=True)
        starts = np.flatnonzero(places)[first]
        found.append((distinct, codes[starts[:, None] + np.arange(ORDER)], counts))
        if len(found) > 16:
            found = [_merged(found)]
    return _merged(found)


def _merged(tables):
    if not tables:
        return np.zeros(0, dtype=np.uint64), np.zeros((0, ORDER), dtype=np.uint32), np.zeros(0, dtype=np.int64)
    keys_, grams, counts = (np.concatenate(parts) for parts in zip(*tables))
    distinct, first, inverse = np.unique(keys_, return_index=True, return_inverse=True)
    return distinct, grams[first], np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)


def _strings(grams):
    return np.ascontiguousarray(grams, dtype=np.uint32).view(f"<U{ORDER}").ravel().tolist()


def novelties(text):
    """Shares of distinct n-grams of `NOVEL` characters, for stretches of growing length up to the whole text.

    The first share counts an n-gram once in a stretch of `STRETCH` characters, the second once in one `WIDER` times
    as long, and so on until one stretch holds the text. Texts of fewer than `NOVEL` characters have none.
    """
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    count = len(codes) - NOVEL + 1
    if count < 1:
        return []
    own = np.zeros(count, dtype=np.uint64)
    for i in range(NOVEL):
        own = (own + codes[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
        own ^= own >> np.uint64(29)
    shares, size = [], STRETCH
    while True:
        distinct = 0
        for start in range(0, count, size):
            part = np.sort(own[start : start + size])
            distinct += 1 + int(np.count_nonzero(part[1:] != part[:-1]))
        shares.append(distinct / count)
        if size >= count:
            return shares
        size *= WIDER


def _texts(table):
    return [text or "" for text in table.column("text").to_pylist()]


_COUNTS = pa.schema([("block", pa.int32()), ("gram", pa.string()), ("n", pa.int64()), ("payload", pa.binary()), ("novelty", pa.list_(pa.float64()))])


def _count(packets_, trusted):
    """Distinct n-grams of a block with their trusted counts, packets of its held-back and novelties of all trusted documents."""
    number = packets_.column("block")[0].as_py() if packets_.num_rows else None
    learned = {doc: held for doc, held in zip(*(trusted.column(c).to_pylist() for c in ("doc_id", "held")))}
    tables, kept, shares = [], [], []
    for payload in packets_.column("payload"):
        rows = unpacked(payload.as_py())
        ids, texts = rows.column("doc_id").to_pylist(), _texts(rows)
        train = [text for doc, text in zip(ids, texts) if learned.get(doc) is False]
        other = [text for doc, text in zip(ids, texts) if learned.get(doc) is not False]
        shares += [novelties(text) for doc, text in zip(ids, texts) if doc in learned]
        tables.append(gram_table(train))
        distinct, grams, counts = gram_table(other)
        tables.append((distinct, grams, np.zeros_like(counts)))
        if len(tables) > 16:
            tables = [_merged(tables)]
        held = [i for i, doc in enumerate(ids) if learned.get(doc)]
        if held:
            part = rows.select(["doc_id", "text", "lang"]).take(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as writer:
                writer.write_table(part)
            kept.append(zstandard.compress(sink.getvalue(), 6))
    _, grams, counts = _merged(tables)
    rows, rest = len(grams), len(kept) + len(shares)
    columns = (
        [number] * (rows + rest),
        _strings(grams) + [None] * rest,
        counts.tolist() + [None] * rest,
        [None] * rows + kept + [None] * len(shares),
        [None] * (rows + len(kept)) + shares,
    )
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _COUNTS.types)], schema=_COUNTS)


def block_grams(packed, labels, blocks, held_back=HELD_BACK):
    """(block, gram, n, payload, novelty): n-grams with trusted counts, held-back documents, and novelties, per block."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    good = good.agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality = 1 and coalesce(toxic, 0) = 0")
    trusted = good.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"),
        "doc_id",
        (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(held_back)) == 0).alias("held"),
    )
    return packed.groupBy("block").cogroup(trusted.groupBy("block")).applyInArrow(_count, "block int, gram string, n long, payload binary, novelty array<double>")


# ---- model --------------------------------------------------------------------------------------------------


def levels(grams):
    """Order to table (gram, c): trusted counts at the highest order, continuation counts below."""
    found = {ORDER: grams.groupBy("gram").agg(F.sum("n").alias("c"))}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.substring("gram", 2, order)
        found[order] = found[order + 1].groupBy(shorter.alias("gram")).agg(F.sum((F.col("c") > 0).cast("long")).alias("c"))
    return found


def discounts(counts_of_counts):
    """D1, D2 and D3+ from the numbers of n-grams seen once to four times; fixed fallbacks where one is missing."""
    n1, n2, n3, n4 = counts_of_counts
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    values = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(value, 0.05), bound) for value, bound in zip(values, (0.95, 1.95, 2.95)))


def probabilities(grams):
    """(gram, logp): log probability of the last character of every n-gram of the corpus after the others.

    Interpolated: max(c - D(c), 0) / total(context) + (D1 n1 + D2 n2 + D3 n3) / total(context) * p(shorter gram).
    A context without trusted counts passes the shorter probability on. The lowest order is uniform.
    """
    tables = levels(grams)
    summary = None
    for order, table in tables.items():
        row = table.agg(F.lit(order).alias("order"), *[F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count(F.when(F.col("c") > 0, 1)).alias("seen"))
        summary = row if summary is None else summary.union(row)
    facts = {row["order"]: row for row in summary.collect()}  # one row per order
    below = None
    for order in range(1, ORDER + 1):
        d1, d2, d3 = discounts([facts[order][f"n{i}"] for i in (1, 2, 3, 4)])
        c = F.col("c")
        cut = F.when(c == 0, 0.0).when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        context = Window.partitionBy(F.substring("gram", 1, order - 1))
        table = tables[order].select("gram", "c", F.sum("c").over(context).alias("total"), F.sum(cut).over(context).alias("left"), cut.alias("cut"))
        if below is None:
            table = table.withColumn("shorter", F.lit(1.0 / (facts[1]["seen"] + 1)))
        else:
            table = table.join(below.select(F.col("gram").alias("tail"), F.col("p").alias("shorter")), F.substring("gram", 2, order - 1) == F.col("tail"))
        p = F.when(F.col("total") > 0, (c - F.col("cut") + F.col("left") * F.col("shorter")) / F.col("total")).otherwise(F.col("shorter"))
        below = table.select("gram", p.alias("p"))
    return below.select("gram", F.log("p").cast("float").alias("logp"))


# ---- scores -------------------------------------------------------------------------------------------------


class GramScores:
    """Scores of a block's n-grams, looked up for many places at once."""

    BITS = 20

    def __init__(self, grams, logps):
        codes = np.array(grams, dtype=f"<U{ORDER}").view(np.uint32).reshape(-1, ORDER) if grams else np.zeros((0, ORDER), np.uint32)
        own = keys(codes.ravel())[::ORDER] if len(codes) else np.zeros(0, dtype=np.uint64)
        logps = np.asarray(logps, dtype=np.float32)
        self.slots, self.values = np.zeros(1 << self.BITS, dtype=np.uint64), np.zeros(1 << self.BITS, dtype=np.float32)
        places = (own >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.slots[places], self.values[places] = own, logps
        rest = self.slots[places] != own  # n-grams whose place another one holds
        order = np.argsort(own[rest])
        self.more, self.more_values = own[rest][order], logps[rest][order]

    def sums(self, texts):
        """Sums of log probabilities and of their squares per text."""
        codes, ends, sizes = code_points(texts)
        own = keys(codes)
        places = (own >> np.uint64(64 - self.BITS)).astype(np.int64)
        found = self.values[places]
        missed = np.flatnonzero(self.slots[places] != own)
        if len(missed) and len(self.more):
            at = np.minimum(np.searchsorted(self.more, own[missed]), len(self.more) - 1)
            found[missed] = np.where(self.more[at] == own[missed], self.more_values[at], 0.0)
        else:
            found[missed] = 0.0
        first, last = np.maximum(ends - sizes - ORDER + 1, 0), np.maximum(ends - ORDER + 1, 0)
        running = [np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)]) for values in (found, found * found)]
        return [(total[last] - total[first]).tolist() for total in running]


def _scored(names, schema):
    def score(packets_, grams):
        scores = GramScores(grams.column("gram").to_pylist(), grams.column("logp").to_numpy())
        tables = []
        for payload in packets_.column("payload"):
            rows = unpacked(payload.as_py())
            texts = _texts(rows)
            sums, squares = [], []
            for part in _slices(texts):
                for found, values in zip((sums, squares), scores.sums(part)):
                    found += values
            sizes = [len(text) for text in texts]
            perplexity = [math.exp(-s / n) if n else None for s, n in zip(sums, sizes)]
            rows = rows.select(names).append_column("n_tokens", pa.array(sizes, pa.int64()))
            rows = rows.append_column("perplexity", pa.array(perplexity, pa.float64()))
            variance = [max(0.0, q / n - (s / n) ** 2) if n else None for s, q, n in zip(sums, squares, sizes)]
            rows = rows.append_column(schema.names[-2], pa.array(variance, pa.float64()))
            tables.append(rows.append_column(schema.names[-1], pa.array([novelties(text) for text in texts], pa.list_(pa.float64()))))
        return pa.concat_tables(tables).cast(schema) if tables else schema.empty_table()

    return score


def with_perplexity(packed, block_scores, source, names):
    """Columns `names` of the packed rows with n_tokens, perplexity, variance of log probabilities, and novelties.

    Perplexity and variance are null for texts without a character.
    """
    kind = T.StructType([source.schema[name] for name in names]).add("n_tokens", T.LongType()).add("perplexity", T.DoubleType())
    kind = kind.add(_own_name(names, "variance"), T.DoubleType()).add(_own_name(names, "novelty"), T.ArrayType(T.DoubleType()))
    function = _scored(names, to_arrow_schema(kind))
    return packed.groupBy("block").cogroup(block_scores.groupBy("block")).applyInArrow(function, kind)


def _looked_up(values, column):
    """The value that a dictionary has for a column; null without one."""
    if not values:
        return F.lit(None).cast("double")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(column))


def _drawn(n, own, pooled, prior=PRIOR):
    """The quantile of n documents of a group, drawn towards the one over all groups, which counts as `prior` documents."""
    return (n * own + prior * pooled) / (n + prior)


def _widening(short, size="n_tokens"):
    """How much wider than for a long text the margin of a text of so many characters is."""
    return F.sqrt(1 + F.lit(float(short)) / F.greatest(F.col(size), F.lit(1)))


def thresholds(held, quantile=QUANTILE):
    """(language to (middle, width), the same over all languages or None, short) from held-back trusted documents.

    The log perplexity of n characters may reach middle + width * sqrt(1 + short / n). `middle` is a median. `short`
    is the variance of a character's log probability over the variance between documents, so that the margin grows
    with the standard deviation of a mean over n characters. One rule for every number of documents: what documents
    exceed the median by, over the root, has a quantile in the language and one over all languages, and the width is
    their mean, weighted with the documents of the language and `PRIOR`. Without `LEAST_HELD` documents there is none.
    """
    usable = held.where("n_tokens > 0").select("lang", "n_tokens", "variance", F.log("perplexity").alias("x"))
    half = F.percentile_approx("x", 0.5, 10_000).alias("middle")
    facts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), half).collect()  # one row per language
    sizes = {row["lang"]: row["n"] for row in facts}
    if sum(sizes.values()) < LEAST_HELD:
        return {}, None, 0.0
    middles = {row["lang"]: row["middle"] for row in facts if row["lang"] is not None and row["n"] >= LEAST_HELD}
    total = usable.agg(half).first()["middle"]
    over = usable.withColumn("over", F.col("x") - F.coalesce(_looked_up(middles, "lang"), F.lit(total)))
    each = F.sum(F.col("variance") * F.col("n_tokens")) / F.sum("n_tokens")
    spread = over.agg(each.alias("each"), F.percentile_approx(F.abs("over"), 0.5, 10_000).alias("between")).first()
    between = (1.4826 * spread["between"]) ** 2  # from the median deviation, as for a normal distribution
    short = spread["each"] / between if between > 0 else 0.0
    over = over.withColumn("over", F.col("over") / _widening(short)).withColumn("all", (F.col("x") - total) / _widening(short))
    top = F.percentile_approx("over", quantile, 10_000).alias("top")
    pooled = over.agg(top, F.percentile_approx("all", quantile, 10_000).alias("all")).first()
    rows = over.where(F.col("lang").isin(list(middles))).groupBy("lang").agg(top).collect()
    by_language = {row["lang"]: (middles[row["lang"]], _drawn(sizes[row["lang"]], row["top"], pooled["top"])) for row in rows}
    return by_language, (total, pooled["all"]), short


def novelty_thresholds(trusted, quantile=QUANTILE):
    """The least novelty that is not repetition, one for each length of stretch, from trusted documents.

    It is the (1 - quantile) quantile over all languages; None where fewer than `LEAST_HELD` documents have that length.
    """
    places = trusted.select(F.posexplode("novelty").alias("place", "share")).groupBy("place")
    found = places.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("share", 1 - quantile, 10_000).alias("least")).collect()
    least = {row["place"]: row["least"] for row in found if row["n"] >= LEAST_HELD}  # one row per length of stretch
    return [least.get(place) for place in range(max(least, default=-1) + 1)]


def judged(docs, labels, names, quantile=QUANTILE, block_bytes=BLOCK_BYTES):
    """Columns `names` of every document with n_tokens, perplexity, threshold and kept.

    kept is false where the perplexity is above the threshold of the document's language, or where the document
    repeats itself: one of its novelties is under that of nearly all trusted documents. Both tests share the allowed
    share of false rejections, 1 - quantile. A language with too few
    held-back trusted documents, null included, takes the threshold over all languages; where these are too few as
    well there is none and everything is kept. Texts without a character, null included, have no perplexity
    and are kept; of others, the threshold is wider the shorter they are. Repeated rows are judged each; an empty table gives no rows.
    """
    blocks = block_count(docs, block_bytes)
    packed = packets(docs, blocks)
    stored = cut_lineage(block_grams(packed, labels, blocks))
    grams = stored.where(F.col("gram").isNotNull())
    scores = cut_lineage(grams.select("block", "gram").join(probabilities(grams.select("gram", "n")), "gram"))
    held_packets = stored.where(F.col("payload").isNotNull()).select("block", "payload")
    held = cut_lineage(with_perplexity(held_packets, scores, docs, ["doc_id", "lang"]))
    each = (1 + quantile) / 2
    by_language, overall, short = thresholds(held, each)
    least = F.array(*[F.lit(x).cast("double") for x in novelty_thresholds(stored.where(F.col("novelty").isNotNull()), each)]).cast("array<double>")
    found = with_perplexity(packed, scores, docs, names if "lang" in names else [*names, "lang"])
    middle, width = (
        F.coalesce(_looked_up({lang: pair[i] for lang, pair in by_language.items()}, "lang"), F.lit(overall and overall[i]).cast("double")) for i in (0, 1)
    )
    limit = F.exp(middle + width * _widening(short))
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    variance, novelty = found.columns[-2:]
    repeats = F.coalesce(F.exists(F.zip_with(novelty, least, lambda share, bound: F.coalesce(share < bound, F.lit(False))), lambda x: x), F.lit(False))
    found = found.withColumn("threshold", limit).withColumn("kept", kept & ~repeats).drop(variance, novelty)
    return found if "lang" in names else found.drop("lang")


def perplexities(docs, labels, quantile=QUANTILE):
    """Per document: doc_id, lang, n_tokens, perplexity, threshold, kept."""
    return judged(docs.select("doc_id", "text", "lang"), labels, ["doc_id", "lang"], quantile)


def trusted_quality(docs, labels, quantile=QUANTILE):
    """The documents that are kept, with all their columns."""
    return judged(docs, labels, docs.columns, quantile).where("kept").select(docs.columns)
