import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from compare import connect, differences
from pyspark.sql import types as T

from gridtide.llm import lookups, queries, tries

SF = "/root/testdata/sf0.01"
SCHEMA = T.StructType().add("conv_id", "long").add("turn", "long").add("role", "string").add("text", "string").add("key", "string").add("depth", "string")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(*row, "x", "x") for row in rows], SCHEMA)


def rebuilt(rows):
    """{conv_id: list of (role, text)} by the definition."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {conv: [t[3:] for t in sorted(turns)] for conv, turns in own.items()}
    found = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        found[conv] = own.get(conv - (abs(conv) % 20) * (1 if conv >= 0 else -1), [])[:h] + turns[h:]
    return found


def brute_force(rows):
    """All nodes by listing every prefix of every conversation."""
    members, ended = defaultdict(list), defaultdict(list)
    for conv, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ended[tuple(turns)].append(conv)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, convs in members.items():
        words = (len(convs) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += words
    return Counter(
        (min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ended.get(node, [])))).encode()).hexdigest())
        for node, convs in members.items()
    )


def awkward_conversations(seed=1, n=90):
    draw, rows = random.Random(seed), []
    for conv in [*range(-25, n), 10_000, 10_001, 5_000_000_020, 5_000_000_021]:
        for turn in range(draw.choice([1, 1, 2, 3, 4, 5, 6])):
            rows.append((conv, turn, draw.choice(["user", "assistant", None, ""]), draw.choice(["hi there", "one two three", "", None, "ok\x0bgo é"])))
    rows += [(None, 0, "user", "no conversation"), (3, None, "user", "null turn"), (4, 1, "user", "a tie"), (4, 1, "user", "another tie"), (5, 0, "user", "repeated")]
    rows += [(5, 0, "user", "repeated"), (7, 9, "user", "long " * 50_000), (8, 9, "user", "long " * 50_000), (6, 2, "ab", "c"), (9, 2, "a", "bc")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_awkward_rows_equal_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(lookups, "HOT", 3)
        monkeypatch.setattr(tries, "RUN_BITS", 2)
    rows = awkward_conversations(seed)
    found = Counter(map(tuple, tries.prefix_trie(frame(spark, rows).repartition(5)).collect()))
    assert found == brute_force(rows)


def test_no_conversations(spark):
    assert tries.prefix_trie(frame(spark, [])).collect() == []
    assert tries.prefix_trie(frame(spark, [(None, 1, "user", "x")])).collect() == []


def test_only_turnless_conversations(spark):
    """Conversations whose own turns are all replaced by those of a conversation that does not exist."""
    convs = [c for c in range(101, 120) if zlib.crc32(str(c).encode()) % 4][:5]
    rows = [(c, 0, "user", "x") for c in convs]
    assert Counter(map(tuple, tries.prefix_trie(frame(spark, rows)).collect())) == brute_force(rows)


def test_long_conversations_take_few_rounds(spark, monkeypatch):
    """Stretches in which nothing ends or merges are stripped at once."""
    shared = [f"turn {i}" for i in range(300)]
    rows = [(40, i, "user", text) for i, text in enumerate(shared)]
    rows += [(60, i, "user", text) for i, text in enumerate(shared[:120] + [f"other {i}" for i in range(80)])]
    rows += [(c, i, "user", f"turn {i}") for c in range(80, 100) for i in range(3)]
    rounds, grouped = [], tries._grouped
    monkeypatch.setattr(tries, "_grouped", lambda rows, depth: rounds.append(depth) or grouped(rows, depth))
    assert Counter(map(tuple, tries.prefix_trie(frame(spark, rows)).collect())) == brute_force(rows)
    assert len(rounds) <= 8


def test_query_equals_sql(spark):
    name = "op13_prefix_trie"
    assert differences(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    assert Counter(map(tuple, queries.QUERIES["op13_prefix_trie"](spark, SF).collect())) == brute_force(rows)
