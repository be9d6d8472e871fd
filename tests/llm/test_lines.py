import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import llm_cases
import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from gridtide.llm import lines, lookups, queries

SF = "/root/testdata/sf0.01"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, least=20, documents=3, choose=max):
    """(doc_id, n_lines, n_dropped, text) of every row, straight from the definition."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= least:
                holders[key(line)].add(doc)
    kept_by = {k: choose(docs) for k, docs in holders.items() if len(docs) >= documents}
    found = []
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        kept = [line for line in all_lines if doc is None or kept_by.get(key(line), doc) == doc]
        found.append((doc, len(all_lines), len(all_lines) - len(kept), None if text is None else "\n".join(kept)))
    return Counter(found)


def shared_rows():
    """Documents around the length and count limits, with a line that most of them share."""
    draw = random.Random(5)
    pool = [f"Shared line number {i} with a tail" for i in range(6)] + ["naïve café 日本語 twenty", "x" * 19, "y" * 20, "é" * 19, "é" * 20]
    rows = llm_cases.awkward_rows()
    for i in range(100, 220):
        parts = [draw.choice(pool) for _ in range(draw.randrange(5))] + [f"own line of document {i} and no other"]
        parts = [draw.choice(["", " ", "\t\x0b"]) + (part.upper() if draw.random() < 0.3 else part) + draw.choice(["", "\r", "  "]) for part in parts]
        draw.shuffle(parts)
        rows.append((i, "\n".join(parts + ["a very common line for all of them"] * (i % 3)), "en", "a", 1))
    rows.append((50, "Shared line number 0 with a tail\n" * 3000, "en", "a", 1))
    rows += [rows[-1], (None, "a very common line for all of them", "en", "a", 1)]
    return rows


@pytest.mark.parametrize(("keep", "choose", "documents"), [(F.max, max, 3), (F.min, min, 2)])
def test_awkward_rows_equal_brute_force(spark, keep, choose, documents):
    rows = shared_rows()
    docs = llm_cases.frame(spark, rows).repartition(7)
    found = lines.deduplicated_lines(docs, documents=documents, keep=keep).collect()
    assert Counter(map(tuple, found)) == brute_force([row[:2] for row in rows], documents=documents, choose=choose)


def test_full_filters_and_hot_keys_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lines, "filter_size", lambda n: (lines.PIECE_BITS, 1))
    monkeypatch.setattr(lookups, "HOT", 10)
    rows = shared_rows() + [(1000 + i, f"unique line {i} of a long list\n" * 2 + f"other unique line {i} here", "en", "a", 1) for i in range(2000)]
    found = lines.deduplicated_lines(llm_cases.frame(spark, rows).repartition(5)).collect()
    assert Counter(map(tuple, found)) == brute_force([row[:2] for row in rows])


def test_empty_table(spark):
    docs = llm_cases.frame(spark, [])
    assert lines.deduplicated_lines(docs).collect() == []
    assert lines.deduplicated_lines(llm_cases.frame(spark, [(1, None, None, None, None)])).collect()[0][1:] == (1, 0, None)


def test_filters_miss_no_repeat_and_pass_few_others():
    draw = np.random.default_rng(3)
    bits, count = lines.filter_size(20_000)
    keys = draw.integers(0, 1 << 63, size=20_000, dtype=np.uint64)
    left, right = lines.SeenFilters(bits, count), lines.SeenFilters(bits, count)
    for part in np.array_split(keys[:12_000], 7):
        left.note(part)
    right.note(keys[11_000:])  # a thousand keys on both sides
    left.note(keys[:500])  # and five hundred twice on one side
    merged = left.twice | right.twice | (left.once & right.once)
    hit = lambda wanted: ((merged[(p := lines.probes(wanted, bits, count)) >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
    assert hit(keys[11_000:12_000]).all() and hit(keys[:500]).all()
    assert hit(np.concatenate([keys[500:11_000], keys[12_000:]])).mean() < 0.005


def test_filter_size_is_bounded():
    assert lines.filter_size(0)[0] == lines.PIECE_BITS
    assert lines.filter_size(10**12)[0] == lines.MOST_BITS
    assert lines.filter_size(10**6)[0] == 1 << 23


def test_only_suspects_are_shuffled(spark):
    """Of documents with lines of their own, nothing reaches the exact count."""
    rows = [(i, f"a line that only document {i} has\nand another one of document {i}", "en", "a", 1) for i in range(3000)]
    marked = lines.with_suspects(llm_cases.frame(spark, rows, extra=False).select("doc_id", "text"))
    assert marked.where(F.size("suspects") > 0).count() < 0.05 * 3000


def test_query_equals_sql(spark):
    name = "op11_line_dedup"
    assert differences(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    wanted = Counter((doc, n, gone, hashlib.sha256((text or "").encode()).hexdigest()) for doc, n, gone, text in brute_force(rows).elements())
    found = queries.QUERIES["op11_line_dedup"](spark, SF).collect()
    assert Counter(map(tuple, found)) == wanted
    assert sum(row.n_dropped for row in found) > 500
