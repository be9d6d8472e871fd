"""Removal of lines that many documents share, with two Bloom filters in front of the exact count.

A line's key is the line without white space at its ends and with A-Z in lower case. Every task notes the keys of
its documents in two filters of equal size: bits that a key has set once, and bits that were set again. Two partial
filters merge by the same rule (a bit is seen twice if either side has it twice or both have it once), so a key of
two documents has all its bits in the merged second filter wherever the documents were read. Only keys that pass
it are suspects; they alone are shuffled, as a digest and a document number, for the exact count of documents and
the choice of the document that keeps the line. Documents without a suspect line are never shuffled.

The filters have eight bits a line up to a fixed largest size, which bounds what is broadcast. Beyond it they fill
up: more unique lines are shuffled as suspects, and the result stays the same.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import functions as F

from gridtide.functions.sizes import cut_lineage
from gridtide.llm.lookups import looked_up

LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
SPACE = b" \t\n\x0b\x0c\r"
BITS_PER_LINE = 8
#: Bits of the largest filter; the driver and every worker hold an eighth of that in bytes, and twice that while building.
MOST_BITS = 1 << 28
#: Bits of a piece in which filters are merged.
PIECE_BITS = 1 << 18
#: Line hashes noted in one step.
NOTED_TOGETHER = 1 << 16


def line_key(line, least=LEAST_CHARS):
    """The key of a line given as UTF-8 bytes; None for lines with a key of under `least` code points."""
    key = line.strip(SPACE).lower()  # bytes have only A-Z lowered
    size = len(key)
    if size < least:
        return None
    if size < 4 * least and not key.isascii() and len(key.decode()) < least:
        return None
    return key


def line_keys(data, least=LEAST_CHARS):
    """The distinct keys of a text."""
    keys = {line_key(line, least) for line in data.split(b"\n")}
    keys.discard(None)
    return keys


def digest(key):
    """128 bits that stand for a key in the exact count."""
    return hashlib.blake2b(key, digest_size=16).digest()


def filter_size(lines):
    """(bits, probes) of the filters for about so many distinct lines: a power of two, and the probes with the fewest suspects."""
    bits = PIECE_BITS
    while bits < min(lines * BITS_PER_LINE, MOST_BITS):
        bits *= 2
    load = max(lines, 1) / bits
    passing = lambda k: (1 - math.exp(-k * load)) ** k  # noqa: E731  share of unique keys all of whose bits others have set too
    return bits, min(range(1, 9), key=passing)


def probes(hashes, bits, count):
    """Bit positions of 64-bit hashes, one row per hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    turns = np.arange(count, dtype=np.uint64)
    return (hashes[:, None] + turns * step[:, None]) & np.uint64(bits - 1)


class SeenFilters:
    """The bits that keys have set once or more, and those set again."""

    def __init__(self, bits, count):
        self.bits, self.count = bits, count
        self.once, self.twice = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)

    def note(self, hashes):
        """Note keys; a key noted twice, in this call or in different ones, has all its bits in `twice`."""
        places, seen = np.unique(probes(hashes, self.bits, self.count), return_counts=True)
        masks = np.left_shift(1, places & np.uint64(7)).astype(np.uint8)
        cells, first = np.unique(places >> np.uint64(3), return_index=True)
        if not len(cells):
            return
        cells = cells.astype(np.int64)
        again = np.bitwise_or.reduceat(np.where(seen > 1, masks, np.uint8(0)), first)
        masks = np.bitwise_or.reduceat(masks, first)
        self.twice[cells] |= again | (self.once[cells] & masks)
        self.once[cells] |= masks

    def pieces(self):
        """(number, compressed bits seen once, compressed bits seen twice) of the pieces with any bit."""
        packer, size = zstandard.ZstdCompressor(level=1), PIECE_BITS // 8
        for i in np.flatnonzero(self.once.reshape(-1, size).any(axis=1)):
            part = slice(i * size, (i + 1) * size)
            yield int(i), packer.compress(self.once[part].tobytes()), packer.compress(self.twice[part].tobytes())


def _unpacked(data):
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)


_PIECES = pa.schema([("number", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _hashed(texts, least):
    """Arrays of the key hashes of texts, a key once per text."""
    held = []
    for text in texts.cast(pa.binary()).to_pylist():
        if text:
            held += map(xxhash.xxh3_64_intdigest, line_keys(text, least))
            if len(held) >= NOTED_TOGETHER:
                yield np.array(held, dtype=np.uint64)
                held = []
    yield np.array(held, dtype=np.uint64)


def _noting(bits, count, least):
    def note(batches):
        filters = SeenFilters(bits, count)
        for batch in batches:
            for hashes in _hashed(batch.column("text"), least):
                filters.note(hashes)
        for piece in filters.pieces():
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(piece, _PIECES.types)], schema=_PIECES)

    return note


def _merging(batches):
    """Pieces of one number become one; a task holds the pieces of its numbers only."""
    merged = {}
    for batch in batches:
        for row in batch.to_pylist():
            once, twice = _unpacked(row["once"]), _unpacked(row["twice"])
            if row["number"] not in merged:
                merged[row["number"]] = once.copy(), twice.copy()
                continue
            all_once, all_twice = merged[row["number"]]
            all_twice |= twice | (all_once & once)
            all_once |= once
    packer = zstandard.ZstdCompressor(level=1)
    for number, (_, twice) in merged.items():
        if twice.any():
            arrays = [pa.array([number], pa.int32()), pa.array([packer.compress(twice.tobytes())], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["number", "twice"])


def seen_twice(docs, bits, count, least=LEAST_CHARS):
    """Compressed pieces of the merged second filter, by number: at most `bits` / 8 bytes in all."""
    partial = docs.select("text").mapInArrow(_noting(bits, count, least), "number int, once binary, twice binary")
    merged = partial.repartition("number").mapInArrow(_merging, "number int, twice binary")
    return {row["number"]: row["twice"] for row in merged.toLocalIterator()}


_MARKED = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("suspects", pa.list_(pa.binary()))])


def _marking(pieces, bits, count, least):
    def mark(batches):
        twice = np.zeros(bits // 8, dtype=np.uint8)
        for number, data in pieces.items():
            twice[number * PIECE_BITS // 8 : (number + 1) * PIECE_BITS // 8] = _unpacked(data)
        for batch in batches:
            suspects = []
            for doc, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary())):
                keys = list(line_keys(text.as_py(), least)) if doc.is_valid and text.is_valid else []
                places = probes(np.array([xxhash.xxh3_64_intdigest(key) for key in keys], dtype=np.uint64), bits, count)
                hit = ((twice[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
                suspects.append([digest(keys[i]) for i in np.flatnonzero(hit)])
            arrays = [batch.column("doc_id"), batch.column("text"), pa.array(suspects, _MARKED.types[2])]
            yield pa.RecordBatch.from_arrays(arrays, schema=_MARKED)

    return mark


def with_suspects(docs, least=LEAST_CHARS):
    """(doc_id, text, suspects): digests of the lines that probably occur in another document too, none of them missing."""
    lines = F.octet_length("text") - F.octet_length(F.translate("text", "\n", "")) + 1
    total = docs.agg(F.sum(lines).alias("n")).first()["n"] or 0
    bits, count = filter_size(total)
    pieces = seen_twice(docs, bits, count, least)
    return docs.mapInArrow(_marking(pieces, bits, count, least), "doc_id long, text string, suspects array<binary>")


def repeated_lines(marked, documents=LEAST_DOCUMENTS, keep=F.max):
    """(suspect, n, holder): lines of at least so many documents, and the document that keeps its own."""
    found = marked.select("doc_id", F.explode("suspects").alias("suspect"))
    once = found.groupBy("suspect", "doc_id").agg(F.lit(1).alias("one"))  # spreads a frequent line over its documents
    counts = once.groupBy("suspect").agg(F.count("doc_id").alias("n"), keep("doc_id").alias("holder"))
    return counts.where(F.col("n") >= documents)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())])


def without_lines(text, drops, least=LEAST_CHARS):
    """(number of lines, dropped lines, the others joined) of a text in bytes and a set of digests to drop."""
    if not drops:
        return text.count(b"\n") + 1, 0, text
    lines = text.split(b"\n")
    kept = [line for line in lines if (key := line_key(line, least)) is None or digest(key) not in drops]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _dropping(least):
    def drop(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            rows = [without_lines(text or b"", set(drops or ()), least) for text, drops in zip(texts, batch.column("drops").to_pylist())]
            n_lines, n_dropped, kept = zip(*rows) if rows else ((), (), ())
            kept = pa.array([None if text is None else new for text, new in zip(texts, kept)], pa.binary()).cast(pa.string())
            arrays = [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), kept]
            yield pa.RecordBatch.from_arrays(arrays, schema=_KEPT)

    return drop


def deduplicated_lines(docs, least=LEAST_CHARS, documents=LEAST_DOCUMENTS, keep=F.max):
    """Per document: doc_id, n_lines before dropping, n_dropped and the text without the lines that others keep.

    A line whose key has at least `least` code points and stands in at least `documents` documents stays only in
    the document that `keep` (an aggregate such as F.max or F.min) chooses of their doc_ids, there as often as it
    occurs. A null text stays null; null and empty texts have one line. Rows that share a doc_id are one
    document, each treated alike; rows with a null doc_id neither count nor lose lines. Repeated rows give repeated
    rows, extra columns are ignored, an empty table gives no rows. A text of any length is handled whole, in one row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = cut_lineage(with_suspects(docs, least))
    repeated = cut_lineage(repeated_lines(marked, documents, keep))
    found = marked.select("doc_id", F.explode("suspects").alias("suspect"))
    drops = looked_up(found, repeated, "suspect", "n").where("doc_id <> holder").groupBy("doc_id").agg(F.collect_set("suspect").alias("drops"))
    clean = marked.where(F.size("suspects") == 0).select("doc_id", "text", F.lit(None).cast("array<binary>").alias("drops"))
    touched = marked.where(F.size("suspects") > 0).select("doc_id", "text").join(drops, "doc_id", "left")
    return clean.unionByName(touched).mapInArrow(_dropping(least), "doc_id long, n_lines long, n_dropped long, text string")
