from collections import Counter, defaultdict

import llm_cases
import numpy as np

from gridtide.llm import neardup, queries

SF = "/root/testdata/sf0.01"


def sets_of(rows):
    out = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        own = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
        out.setdefault(doc, []).append(own)
    return out


def brute(rows, percent=75):
    """doc_id to its smallest reachable doc_id, by comparing every pair with a common shingle."""
    sets, parent, holders = sets_of(rows), {}, defaultdict(set)
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for doc, versions in sets.items():
        for own in versions:
            for other in set().union(*(holders[s] for s in own)) if own else ():
                for theirs in sets[other]:
                    common = len(own & theirs)
                    if common and 100 * common >= percent * (len(own) + len(theirs) - common):
                        a, b = root(doc), root(other)
                        parent[max(a, b)] = min(a, b)
            for s in own:
                holders[s].add(doc)
    return {doc: root(doc) for doc in sets}


def check(found, rows):
    wanted, sizes = brute([(d, t) for d, t in rows if d is not None]), sets_of(rows)
    assert Counter(row.doc_id for row in found) == Counter(d for d, _ in rows)
    for row in found:
        assert row.n_shingles in {len(s) for s in sizes[row.doc_id]}
        if row.doc_id is None:
            assert row.component_id is None and row.kept
        else:
            assert row.component_id == wanted[row.doc_id] and row.kept == (row.doc_id == wanted[row.doc_id]), row


def test_shingles_tell_orders_and_lengths_apart():
    a = neardup.shingle_set(b"a b c d e".split())
    assert len(a) == 1 and a[0] != neardup.shingle_set(b"e d c b a".split())[0]
    assert neardup.shingle_set(b"a b".split())[0] != neardup.shingle_set(b"a b a b a".split())[0]
    words = [b"x", b"y"] * 400 + [b"x"] * 50
    assert len(neardup.shingle_set(words)) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})


def test_signature_agreement_estimates_similarity():
    draw = np.random.default_rng(0)
    pool = draw.integers(0, 1 << 63, size=1500, dtype=np.uint64) * np.uint64(2)
    left, right = np.unique(pool[:1000]), np.unique(pool[500:])
    share = np.mean(neardup.signature(left, 2048) == neardup.signature(right, 2048))
    assert abs(share - 1 / 3) < 0.04


def test_awkward_rows(spark):
    docs = llm_cases.frame(spark, llm_cases.awkward_rows())
    check(neardup.near_duplicates(docs).collect(), [(row[0], row[1]) for row in llm_cases.awkward_rows()])
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(row.doc_id for row in kept.collect())
    assert ids.pop(None) == 2 and set(ids.values()) == {1} and 1 not in ids and {0, 4, 5, 6, 7, 9} <= set(ids)


def test_chains_and_large_groups(spark):
    base = llm_cases.sentence(3, 100).split()
    rows = []
    for i in range(40):  # a chain: neighbours are alike, the ends are not
        rows.append((i, " ".join(base[i * 2 :] + [f"c{j}" for j in range(i * 2)])))
    for i in range(300):  # near copies of one text
        words = llm_cases.sentence(4, 120).split()
        words[(7 * i) % 120] = f"x{i}"
        rows.append((1000 + i, " ".join(words)))
    rows += [(5000 + i, "one common passage of words " * 3 + llm_cases.sentence(900 + i, 40)) for i in range(60)]
    docs = llm_cases.frame(spark, [(d, t, "en", "a", 1) for d, t in rows])
    check(neardup.near_duplicates(docs).collect(), rows)


def test_exact_candidates_miss_no_linked_pair(spark):
    """The join alone, every document with a label of its own."""
    rows = [(d, t) for d, t in [(i, llm_cases.sentence(i // 3, 30 + i % 3, 60)) for i in range(40)]]
    for i in range(40, 80):
        words = llm_cases.sentence(7, 50, 60).split()
        rows.append((i, " ".join(words[: 50 - i % 9] + [f"y{i}"] * (i % 5))))
    sets = {doc: own[0] for doc, own in sets_of(rows).items()}
    wanted = {(a, b) for a in sets for b in sets if a > b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    texts = spark.createDataFrame([(d, d, t) for d, t in rows], "doc_id long, label long, text string")
    pairs = {tuple(row) for row in neardup.exact_candidates(texts, 75).collect()}
    assert wanted and wanted <= pairs and len(pairs) < 80 * 79 / 2
    assert {tuple(row) for row in neardup.confirmed(spark.createDataFrame(sorted(pairs), "a long, b long"), texts, 75).collect()} == wanted


def test_forest_labels_are_roots(spark):
    parents = spark.createDataFrame([(i, i - 1) for i in range(1, 40)] + [(100, 50), (101, 100)], "a long, b long")
    labels = {row.node: row.label for row in neardup.forest_labels(parents).collect()}
    assert all(labels[i] == 0 for i in range(1, 40)) and labels[100] == labels[101] == 50


def test_query_equals_brute_force(spark):
    rows = llm_cases.read(SF, "SELECT doc_id, text FROM documents")
    check(queries.QUERIES["op10_near_duplicates"](spark, SF).collect(), rows)


def test_exact_candidates_make_no_pairs_inside_a_component(spark):
    """Time follows the number of near copies of one component, beside longer texts that share their shingles."""
    import time

    base = llm_cases.sentence(1, 30)

    def seconds(copies):
        rows = [(i, 0, f"{base} tail{i}") for i in range(copies)] + [(10**6 + i, 10**6 + i, f"{base} {llm_cases.sentence(1000 + i, 60)}") for i in range(30)]
        texts = spark.createDataFrame(rows, "doc_id long, label long, text string").repartition(8).cache()
        texts.count()
        start = time.time()
        assert neardup.exact_candidates(texts, 75).count() == 0
        return time.time() - start

    seconds(500)
    few = seconds(4000)
    assert seconds(16_000) <= 5 * max(few, 2.0)


def test_exact_candidates_find_every_pair_across_components(spark):
    import itertools

    rows = [(i, i % 3, llm_cases.sentence(7, 40 + 3 * (i % 4)) + (f" tail{i} end" if i % 2 else "")) for i in range(24)]
    sets = {i: set(neardup.shingle_set(neardup.words_of(text)).tolist()) for i, _, text in rows}
    near = {(max(a, b), min(a, b)) for (a, la, _), (b, lb, _) in itertools.combinations(rows, 2) if la != lb and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    texts = spark.createDataFrame(rows, "doc_id long, label long, text string")
    found = {tuple(row) for row in neardup.exact_candidates(texts, 75).collect()}
    assert near and near <= found and all(a % 3 != b % 3 for a, b in found)
