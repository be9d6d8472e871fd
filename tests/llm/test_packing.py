import random
import zlib
from collections import Counter, defaultdict

import llm_cases
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridtide.llm import packing, queries

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path(packing.VOCABULARY)


def ids_of(tokenizer, text):
    return (tokenizer.encode(text, add_special_tokens=False).ids if text else []) + [1]


def check(found, rows, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    wanted = Counter()
    for doc, text in rows:
        ids = np.array(ids_of(tokenizer, text), dtype="<u4")
        for i, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            wanted[doc, i, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    sequences = defaultdict(list)
    for row in found:
        sequences[row.sequence_id].append((row.offset, row.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(n * count for (_, _, _, n, _), count in wanted.items())


@pytest.mark.parametrize("text", ["İstanbul Σίσυφος ΣΑΣ", "é é ́x", "<|endoftext|> a<|startoftext|>", "don't I'LL it's's 12½", "日本語 x", " \n\t ", "a\x85b\xa0c\x1cd"])
def test_encoder_equals_the_tokenizer(text):
    assert packing.ChunkEncoder(PATH).encode(text).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_encoder_on_random_text_and_with_a_full_cache():
    draw, tokenizer, encoder = random.Random(2), Tokenizer.from_file(PATH), packing.ChunkEncoder(PATH, most=50, most_words=20)
    for _ in range(3000):
        text = "".join(chr(draw.choice([draw.randrange(0, 0x260), draw.randrange(32, 127), 32])) for _ in range(draw.randrange(14)))
        assert encoder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_many_texts_at_once_and_long_ones(monkeypatch):
    monkeypatch.setattr(packing, "STEP_BYTES", 300)
    draw, tokenizer = random.Random(3), Tokenizer.from_file(PATH)
    texts = ["", " ", "a", "x" * 1000, "y" * 70 + " " + "y" * 71, "long words " * 200, "  lead and trail \n", "z" * 299, "z" * 300 + "\t", "z" * 301 + " b"]
    texts += [" ".join("".join(draw.choice("abcdé,.1") for _ in range(draw.randrange(1, 90))) for _ in range(draw.randrange(60))) for _ in range(40)]
    found = [ids.tolist() for ids in packing.ChunkEncoder(PATH).encode_all([text.encode() for text in texts])]
    assert found == [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]


def test_equal_chunks_and_only_they_have_equal_hashes():
    draw = random.Random(5)
    chunks = ["".join(draw.choice("ab") for _ in range(draw.randrange(1, 80))).encode() for _ in range(20_000)]
    starts, ends, hashes = packing.chunk_hashes(b" \n".join(chunks))
    assert len(starts) == len(chunks) and (ends - starts).tolist() == [len(chunk) for chunk in chunks]
    assert len(set(zip(chunks, hashes.tolist()))) == len(set(chunks)) == len(set(hashes.tolist()))


def every_filling(left, room):
    """All undominated fillings by listing every multiset."""
    sizes, found = sorted(left), set()

    def grow(i, filling):
        if i == len(sizes):
            found.add(tuple(sorted(filling)))
            return
        for copies in range(left[sizes[i]] + 1):
            if sum(filling) + copies * sizes[i] <= room:
                grow(i + 1, filling + (sizes[i],) * copies)

    grow(0, ())
    better = lambda f: any(
        left[y] > f.count(y) and x < y and sum(f) - x + y <= room for x in {*f, 0} for y in sizes
    )
    return {f for f in found if not better(f)}


def test_all_undominated_fillings_are_enumerated():
    draw = random.Random(6)
    for _ in range(200):
        left = Counter(draw.randint(1, 12) for _ in range(draw.randint(0, 7)))
        room = draw.randint(0, 25)
        for order in (None, lambda size: (abs(size - 5), size)):
            found = [f for f in packing.fillings(left, room, room, order) if f is not None]
            wastes = [room - sum(f) for f in found]
            assert wastes == sorted(wastes) and len(found) == len(set(found))
            assert {tuple(sorted(f)) for f in found} == every_filling(left, room)


def test_lower_bound_holds():
    draw = random.Random(7)
    for _ in range(150):
        sizes = sorted((draw.randint(4, 11) for _ in range(draw.randint(1, 8))), reverse=True)
        assert packing.lower_bound(Counter(sizes), 20) <= fewest(sizes, 20)


def test_lengths_of_a_fifth_to_two_fifths_of_a_sequence():
    """Three or four pieces a sequence, where best fit wastes a twentieth."""
    draw = random.Random(1)
    counts = Counter(draw.randrange(800, 1701) for _ in range(5000))
    patterns = packing.pack_histogram(counts)
    assert Counter(size for pattern, times in patterns for size in pattern * times) == counts
    assert sum(times for _, times in patterns) <= 1.005 * packing.lower_bound(counts, 4096)
    small = [draw.randrange(800, 1701) for _ in range(11)]
    assert sum(times for _, times in packing.pack_histogram(Counter(small))) == fewest(sorted(small, reverse=True), 4096)


def fewest(sizes, capacity):
    """Smallest number of bins by exhaustive search."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity:
                place(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_solver_places_everything_and_is_near_the_optimum():
    draw, worse = random.Random(4), 0
    for _ in range(120):
        sizes = sorted((draw.randint(1, 20) for _ in range(draw.randint(0, 9))), reverse=True)
        patterns = packing.pack_histogram(Counter(sizes), 20)
        assert Counter(size for pattern, times in patterns for size in pattern * times) == Counter(sizes)
        assert all(sum(pattern) <= 20 for pattern, _ in patterns)
        worse += sum(times for _, times in patterns) > fewest(sizes, 20)
    assert worse == 0


def test_branching_beats_best_fit():
    counts = Counter([6, 6, 5, 5, 4, 4, 3, 3, 3, 3, 3, 3])  # best fit leaves gaps that other fillings close
    assert sum(t for _, t in packing.pack_histogram(counts, 12)) == -(-sum(counts.elements()) // 12)


def test_awkward_rows(spark):
    docs = llm_cases.frame(spark, llm_cases.awkward_rows())
    rows = [(row[0], row[1]) for row in llm_cases.awkward_rows()]
    sequences, total = check(packing.pack(docs, PATH, capacity=64).collect(), rows, 64)
    assert sequences <= -(-total // 64) + 1
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_ranks_across_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARDS", 15)
    rows = [(i, "same words here", "en", "a", 1) for i in range(300)]
    sequences, total = check(packing.pack(llm_cases.frame(spark, rows), PATH, capacity=10).collect(), [(i, "same words here") for i in range(300)], 10)
    assert sequences == 150


def test_query_equals_the_tokenizer_and_fills_sequences(spark):
    rows = llm_cases.read(SF, "SELECT doc_id, text FROM documents")
    sequences, total = check(queries.QUERIES["op9_packing"](spark, SF).collect(), rows, 4096)
    assert sequences <= -(-total // 4096) * 1.005 + 1
