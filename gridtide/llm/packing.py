"""Best-fit packing by bin completion with branch and bound.

Documents are tokenised, closed with an end mark and cut into pieces only where they are longer than a sequence.
Pieces of one length are interchangeable, so what has to be packed is the histogram of lengths: at most as many
rows as a sequence has tokens, however large the corpus is. The solver works on that histogram, and a distributed
ranking of the pieces of each length hands out the places of the solution.

Solver: take the largest remaining length, enumerate the undominated fillings of the room beside it from the least
waste on, and use the chosen filling as often as the counts allow. Fillings of any number of lengths are found one by
one, guided by the sums that the remaining lengths can make. Best-fit decreasing gives the incumbent; a branch ends
once its waste leaves nothing better. A lower bound proves most solutions optimal; otherwise the best packing after
`nodes` choices stands.
"""

import math
import re
import unicodedata
import zlib
from bisect import bisect_right
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridtide.functions.sizes import cut_lineage

CAPACITY = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
NODES = 4_000
#: Frames of the search that keep their enumeration in memory, a few megabytes each; earlier ones start theirs again.
OPEN_FRAMES = 16
#: Parts in which the pieces of one length are ranked.
SHARDS = 1 << 12

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---- tokens -------------------------------------------------------------------------------------------------


@lru_cache
def _tokenizer(path):
    return Tokenizer.from_file(path)


@lru_cache
def _encoder(path):
    """One encoder per worker process, so that its caches serve all tasks of the process."""
    return ChunkEncoder(path)


def _byte_letters():
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [byte for byte in range(256) if byte not in printable]
    return {byte: 256 + i for i, byte in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


#: Chunks of up to this many bytes are hashed together; the few longer ones one by one.
LONGEST = 64
#: Bytes of text that are split and hashed in one step.
STEP_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15  # any odd number: its powers can be taken back
_SPACES = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_LETTERS = np.random.default_rng(11).integers(0, 1 << 63, size=256, dtype=np.uint64)


def _powers(base, count):
    """base^0, base^1, ... modulo 2^64."""
    powers = np.ones(1, dtype=np.uint64)
    while len(powers) < count:
        powers = np.concatenate([powers, powers * np.uint64(pow(base, len(powers), 1 << 64))])
    return powers[:count]


@lru_cache(1)
def _factors(count):
    return _powers(_BASE, count), _powers(pow(_BASE, -1, 1 << 64), count)


def _scattered(values):
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def chunk_hashes(data):
    """(starts, ends, 64-bit hashes) of the white-space separated chunks of a byte string.

    A hash is a polynomial in random numbers that stand for the bytes, taken from running sums over the whole string.
    """
    codes = np.frombuffer(data, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(_SPACES[codes], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    up, down = _factors(max(STEP_BYTES, 1 << (len(data) - 1).bit_length())) if data else _factors(STEP_BYTES)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_LETTERS[codes] * up[: len(codes)], out=sums[1:])
    sizes = ends - starts
    hashes = _scattered((sums[ends] - sums[starts]) * down[starts] + sizes.astype(np.uint64))
    for i in np.flatnonzero(sizes > LONGEST):
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return starts, ends, hashes


def _parts(data, most=STEP_BYTES):
    """A byte string in parts of about `most` bytes that end at white space."""
    start = 0
    while len(data) - start > most:
        found = _GAP.search(data, start + most)
        end = found.start() if found else len(data)
        yield data[start:end]
        start = end
    yield data[start:]


_GAP = re.compile(rb"[ \t\n\x0b\x0c\r]")


class ChunkEncoder:
    """Token ids of whole texts through a cache of white-space separated chunks.

    The vocabulary drops white space and never merges across it or across its word pattern, so the ids of a text
    are the ids of its chunks, and those of a chunk are the ids of its words. Texts are split and hashed many at a
    time; only chunks whose hash the cache lacks go through the tokenizer, word by word. Chunks with letters
    beyond the extended Latin blocks, or with the marks of special tokens, go through it whole. A full cache starts
    anew, which changes no result. Two different chunks share a 64-bit hash with a chance of 2^-64.
    """

    # Fixed value: the word pattern of the vocabulary's own splitter.
    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path, most=500_000, most_words=60_000):
        self.tokenizer, self.most, self.most_words = _tokenizer(path), most, most_words
        self.model = self.tokenizer.model
        self.clear()

    def clear(self):
        self.words, self.used, self.count = {}, 0, 0
        self.keys, self.numbers = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)  # sorted hashes and their entries
        self.flat = np.zeros(1 << 20, dtype=np.uint32)
        self.begins, self.sizes = np.zeros(1 << 17, dtype=np.int64), np.zeros(1 << 17, dtype=np.int64)

    def _split(self, text):
        """The words of a chunk as the vocabulary splits it, or None for chunks that must be encoded whole."""
        if not text.isascii():
            if max(text) >= "\u0250":
                return None
            text = unicodedata.normalize("NFC", text)
        elif text.isalpha():
            return (text.lower(),)
        return None if "<|" in text else self.WORDS.findall(text.lower())

    def _word(self, word):
        found = self.words.get(word)
        if found is None:
            letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
            if len(self.words) >= self.most_words:
                self.words.clear()
            found = self.words[word] = [token.id for token in self.model.tokenize(letters)]
        return found

    def _learn(self, chunks):
        """Enter the ids of new chunks; the number of the first entry."""
        sizes, flat = [], []
        for chunk in chunks:
            text, before = chunk.decode(), len(flat)
            words = self._split(text)
            if words is None:
                flat += self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                for word in words:
                    flat += self._word(word)
            sizes.append(len(flat) - before)
        first, used, n = self.count, self.used, len(flat)
        while first + len(sizes) > len(self.begins):
            self.begins, self.sizes = np.tile(self.begins, 2), np.tile(self.sizes, 2)
        while used + n > len(self.flat):
            self.flat = np.tile(self.flat, 2)
        self.flat[used : used + n] = flat
        part = slice(first, first + len(sizes))
        self.sizes[part] = sizes
        self.begins[part] = used + np.cumsum(sizes) - sizes
        self.used, self.count = used + n, first + len(sizes)
        return first

    def _numbers(self, data, starts, ends, hashes):
        """The entry of every chunk, after entering those that are new."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == distinct[known]
        found = np.zeros(len(distinct), dtype=np.int64)
        found[known] = self.numbers[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            number = self._learn([data[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            found[new] = np.arange(number, number + len(new))
            self.numbers = np.insert(self.numbers, at[new], found[new])
            self.keys = np.insert(self.keys, at[new], distinct[new])
        return found[inverse]

    def _encoded(self, data):
        """(start of every chunk, ids of all chunks, end of every chunk's ids)."""
        if self.count > self.most:
            self.clear()
        starts, ends, hashes = chunk_hashes(data)
        numbers = self._numbers(data, starts, ends, hashes)
        begins, sizes = self.begins[numbers], self.sizes[numbers]
        upto = np.cumsum(sizes)
        ids = self.flat[np.repeat(begins - upto + sizes, sizes) + np.arange(int(sizes.sum()))]
        return starts, ids, upto

    def _several(self, texts):
        """Ids of texts that are split and hashed together."""
        starts, ids, upto = self._encoded(b" ".join(texts))
        ends = np.cumsum([len(text) + 1 for text in texts])  # of the texts in the joined string
        words = np.searchsorted(starts, ends)
        cuts = np.concatenate([[0], upto])[words]
        return np.split(ids, cuts[:-1])

    def encode_all(self, texts):
        """Ids of each text (UTF-8 bytes) as an array, in order."""
        held, size = [], 0
        for text in texts:
            if size + len(text) > STEP_BYTES and held:
                yield from self._several(held)
                held, size = [], 0
            if len(text) > STEP_BYTES:
                yield np.concatenate([self._encoded(part)[1] for part in _parts(text)])
            else:
                held.append(text)
                size += len(text)
        if held:
            yield from self._several(held)

    def encode(self, text):
        """Ids of one text as an array."""
        return next(self.encode_all([text.encode()]))


def cut(ids, capacity):
    """(piece, start, length, crc32 of the ids) of a document's ids."""
    data = np.ascontiguousarray(ids, dtype="<u4")
    return [
        (i, start, min(capacity, len(data) - start), zlib.crc32(data[start : start + capacity].tobytes()))
        for i, start in enumerate(range(0, len(data), capacity))
    ]


def pieces(docs, vocabulary, capacity=CAPACITY, end=END):
    """Pieces of all documents; a null or empty text is the end mark alone."""

    names = [part.split()[0] for part in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def tokenised(batches):
        encoder = _encoder(vocabulary)
        for batch in batches:
            texts = (text or b"" for text in batch.column("text").cast(pa.binary()).to_pylist())
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(texts)):
                rows += [(doc, *piece) for piece in cut(np.append(ids, end), capacity)]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokenised, PIECES)


# ---- solver -------------------------------------------------------------------------------------------------


def best_fit_decreasing(counts, capacity):
    """Patterns (lengths, times): each open bin takes the largest remaining length that fits."""
    left, sizes, patterns = dict(counts), sorted(counts), []
    while sizes:
        pattern, room = [], capacity
        while True:
            at = bisect_right(sizes, room) - 1
            while at >= 0 and pattern.count(sizes[at]) >= left[sizes[at]]:
                at -= 1
            if at < 0:
                break
            pattern.append(sizes[at])
            room -= sizes[at]
        times = min(left[size] // pattern.count(size) for size in set(pattern))
        patterns.append((tuple(pattern), times))
        for size in pattern:
            left[size] -= times
        sizes = [size for size in sizes if left[size]]
    return patterns


def _attainable(sizes, left, room):
    """Per position i, the sums up to `room` that the lengths from i on can make, as the bits of a number."""
    mask, sums, found = (1 << (room + 1)) - 1, 1, [1]
    for size in reversed(sizes):
        copies, step = min(left[size], room // size), 1
        while copies:
            step = min(step, copies)
            sums |= (sums << (step * size)) & mask
            copies, step = copies - step, 2 * step
        found.append(sums)
    return found[::-1]


def _with_sum(sizes, left, sums, wanted, start=0):
    """All fillings with exactly the wanted sum, in the order of `sizes`; no branch is entered that cannot be completed."""
    if not wanted:
        yield ()
        return
    for i in range(start, len(sizes)):
        if not sums[i] >> wanted & 1:
            return
        size = sizes[i]
        for copies in range(min(left[size], wanted // size), 0, -1):
            rest = wanted - copies * size
            if sums[i + 1] >> rest & 1:
                for more in _with_sum(sizes, left, sums, rest, i + 1):
                    yield (size,) * copies + more


def _dominated(filling, ascending, left, waste):
    """True when a larger length fits in place of one of the filling, or another one beside it."""
    for length in {*filling, 0}:
        for size in ascending[bisect_right(ascending, length) : bisect_right(ascending, length + waste)]:
            if left[size] > filling.count(size):
                return True
    return False


def fillings(left, room, slack, order=None):
    """The undominated fillings of `room` from a {length: count}, least waste first, up to a waste of `slack`.

    A filling is dominated when one of its lengths can be replaced by a larger one that fits, or another one be added.
    All others are found, one when it is asked for: the attainable sums say how little waste is possible and which
    branches lead to it. Among equal waste `order` (a sort key of lengths, falling by default) decides. None stands for
    a dominated filling that was passed over, so that a caller can give up.
    """
    ascending = sorted(size for size in left if size <= room and left[size])
    sizes = sorted(ascending, key=order or (lambda size: -size))
    sums = _attainable(sizes, left, room)
    for waste in range(min(slack, room) + 1):
        if sums[0] >> (room - waste) & 1:
            for filling in _with_sum(sizes, left, sums, room - waste):
                yield None if _dominated(filling, ascending, left, waste) else filling


def _around_largest(left, capacity, slack, balanced):
    """(pattern, waste) of the bins around the largest remaining length."""
    largest = max(left)
    less = {size: n - (size == largest) for size, n in left.items() if n > (size == largest)}
    room, order = capacity - largest, None
    if balanced and less:  # lengths near the mean share of the room first
        pieces = sum(left.values())
        mean = sum(size * n for size, n in left.items()) / pieces
        share = room / max(1, round(room / mean))
        order = lambda size: (abs(size - share), size)
    for filling in fillings(less, room, slack, order):
        yield (filling is not None and (largest, *filling)), room - sum(filling or ())


def lower_bound(counts, capacity):
    """Sequences that any packing needs: by the sum of lengths, and by those of which no k + 1 fit together."""
    total = sum(size * n for size, n in counts.items())
    best = -(-total // capacity)
    for k in range(1, 20):
        # A length that is more than j of k + 1 parts of a sequence counts as j of k.
        parts = sum(n * (size / capacity if size * (k + 1) % capacity == 0 else size * (k + 1) // capacity / k) for size, n in counts.items())
        best = max(best, math.ceil(parts - 1e-6))
    return best


class _Choices:
    """The bins around the largest length of one frame, one after the other; their enumeration can be dropped and taken up again."""

    def __init__(self):
        self.taken, self.rest = 0, None

    def following(self, left, capacity, balanced):
        """The next (pattern, waste), (None, 0) after the last; `left` is the same at every call."""
        if self.rest is None:
            self.rest = islice(_around_largest(dict(left), capacity, capacity, balanced), self.taken, None)
        self.taken += 1
        return next(self.rest, (None, 0))


def _searched(counts, capacity, best, bound, nodes, balanced):
    """The best patterns that depth-first branching finds within `nodes` choices, and the number of choices made.

    One choice is a pattern, used as often as the counts allow. A branch ends when its waste leaves no packing that is
    better than the best one known.
    """
    total = sum(size * n for size, n in counts.items())
    best_bins = sum(times for _, times in best)
    left, path, bins, waste, visited = dict(counts), [], 0, 0, 0

    def slack():
        """Waste that a better packing may still have."""
        return (best_bins - 1) * capacity - total - waste

    frames = [_Choices()]
    while frames and best_bins > bound and visited < nodes:
        if len(path) == len(frames):  # back in this frame: undo its last choice
            pattern, times, lost = path.pop()
            for size in pattern:
                left[size] = left.get(size, 0) + times
            bins, waste = bins - times, waste - lost
        pattern, room = frames[-1].following(left, capacity, balanced)
        visited += 1
        if pattern is False:
            continue
        if pattern is None or room > slack() and len(left) > len(set(pattern)):
            frames.pop()
            continue
        times = min(left[size] // pattern.count(size) for size in set(pattern))
        for size in pattern:
            left[size] -= times
        for size in set(pattern):
            if not left[size]:
                del left[size]
        # The last sequence may stay partly empty without costing another, so its room is no waste.
        lost = times * room if left else 0
        path.append((pattern, times, lost))
        bins, waste = bins + times, waste + lost
        if not left:
            if bins < best_bins:
                best_bins, best = bins, [(pattern, times) for pattern, times, _ in path]
        elif slack() >= 0:
            frames.append(_Choices())
            if len(frames) > OPEN_FRAMES:
                frames[-1 - OPEN_FRAMES].rest = None
    return best, visited


def pack_histogram(counts, capacity=CAPACITY, nodes=NODES):
    """Patterns (lengths, times) that place every piece of a {length: count} histogram in few sequences.

    Best-fit decreasing is the first incumbent. Branching starts with two dives, one that completes bins with large
    lengths and one with lengths near the mean of what is left, and goes on from the better one. It ends with a proof
    (the bound is met or no branch is left) or after `nodes` choices, for the problem has no fast exact solution;
    `lower_bound` tells how far from the best possible the result can be.
    """
    counts = {int(size): int(n) for size, n in counts.items() if n}
    if not counts:
        return []
    bound = lower_bound(counts, capacity)
    best, used = best_fit_decreasing(counts, capacity), {}
    for balanced in (False, True):
        dive, _ = _searched(counts, capacity, best, bound, len(counts) + 1, balanced)
        used[balanced] = sum(times for _, times in dive)
        best = dive
    return _searched(counts, capacity, best, bound, nodes, used[True] < used[False])[0]


class Places:
    """Where the r-th piece of each length goes: sequence number and offset, from patterns."""

    def __init__(self, patterns):
        by_length, first = {}, 0
        for pattern, times in patterns:
            offset = 0
            seen = {}
            for size in pattern:
                seen.setdefault(size, []).append(offset)
                offset += size
            for size, offsets in seen.items():
                starts, entries = by_length.setdefault(size, ([0], []))
                entries.append((first, tuple(offsets)))
                starts.append(starts[-1] + times * len(offsets))
            first += times
        self.by_length, self.sequences = by_length, first

    def find(self, length, rank):
        starts, entries = self.by_length[length]
        at = bisect_right(starts, rank) - 1
        first, offsets = entries[at]
        turn, slot = divmod(rank - starts[at], len(offsets))
        return first + turn, offsets[slot]


# ---- distributed assignment ---------------------------------------------------------------------------------


def pack(docs, vocabulary, capacity=CAPACITY, end=END, nodes=NODES):
    """Pieces of all documents with their sequence and offset.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null text is an empty document, which
    is one piece of the end mark. Repeated rows are packed as often as they occur. An empty table gives no rows.

    Pieces are computed once and stored. The driver sees the histogram of lengths, which has at most `capacity`
    rows; ranks within a length come from groups of (length, shard) and from offsets of those groups, so one frequent
    length is ranked by many tasks.
    """
    stored = cut_lineage(pieces(docs, vocabulary, capacity, end))
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SHARDS)).cast("int").alias("shard")
    stored = stored.select("*", shard)
    groups = stored.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))
    histogram = {row["length"]: row["n"] for row in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(pack_histogram(histogram, capacity, nodes))
    earlier = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("length", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = stored.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["length", "shard"])
    ranked = ranked.withColumn("rank", (F.col("rank") + F.col("ahead")).cast("long"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([places.find(length, rank) for length, rank in zip(lengths, ranks)], columns=["sequence_id", "offset"])

    placed = ranked.withColumn("place", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
