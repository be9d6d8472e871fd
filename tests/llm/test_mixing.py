from collections import defaultdict

import llm_cases

from gridtide.llm import mixing, queries

SF = "/root/testdata/sf0.01"


def targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in fixed]
        share = (total - sum(fixed.values())) / sum(weight[s] for s in rest) if rest else 0
        above = [s for s in rest if share * weight[s] >= most * sizes[s]]
        if not above:
            return {**fixed, **{s: share * weight[s] for s in rest}}
        fixed |= {s: most * sizes[s] for s in above}


def check(rows, near):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for row in rows:
        sizes[row.source] += row.size
        taken[row.source] += row.taken
        largest[row.source] = max(largest[row.source], row.size)
        assert 0 <= row.taken <= 3 * row.size and (row.size == 0 or row.taken % row.size == 0)
    wanted = targets(sizes)
    for row in rows:
        assert row.source_size == sizes[row.source] and abs(row.target - wanted[row.source]) <= 1e-6 * max(1, row.target)
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= near(largest[source])


def test_awkward_rows(spark):
    docs = llm_cases.frame(spark, llm_cases.awkward_rows())
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(llm_cases.awkward_rows())
    check(rows, lambda largest: largest + 1)  # rows that repeat id and text are taken together
    assert mixing.mix(docs.limit(0)).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(row.copies for row in rows)


def test_limits_share_the_excess_again(spark):
    rows = [(i, llm_cases.sentence(i, 5 if source == "a" else 100), "en", source, 1) for i, source in enumerate("a" + "b" * 20 + "c" * 20)]
    check(mixing.mix(llm_cases.frame(spark, rows)).collect(), lambda largest: largest / 2 + 1e-6)


def test_small_pieces_give_the_same_sample_as_one_order(spark):
    rows = [(i, llm_cases.sentence(i, 3 + i % 40), "en", "ab"[i % 2], 1) for i in range(600)]
    stored = mixing.cut_lineage(mixing.keyed(llm_cases.frame(spark, rows, extra=False)).drop("text"))
    plans = [mixing.with_copies(stored, mixing.sampling_plan(stored, pieces=p)).select("doc_id", "copies").orderBy("doc_id").collect() for p in (1, 8, 4096)]
    assert plans[0] == plans[1] == plans[2]


def test_the_last_place_goes_to_the_document_that_fits(spark):
    """A front that ends before a long document is filled up by the document of the missing size."""
    sizes = [100] * 8 + [5000] * 3 + list(range(1, 90, 4))
    rows = [(i, llm_cases.sentence(i, n), "en", "a", 1) for i, n in enumerate(sizes)] + [(900 + i, llm_cases.sentence(900 + i, 2000), "en", "b", 1) for i in range(5)]
    for seed in range(6):
        taken, target = defaultdict(int), {}
        for row in mixing.mix(llm_cases.frame(spark, rows), seed=seed).collect():
            taken[row.source] += row.taken
            target[row.source] = row.target
        assert abs(taken["a"] - target["a"]) <= 2500 and abs(taken["b"] - target["b"]) <= 1000


def test_weights_tilt_inclusion(spark):
    rows = [(i, llm_cases.sentence(i, 20), "en", "ab"[i % 2], 1) for i in range(400)]
    docs = llm_cases.frame(spark, rows, extra=False).selectExpr("*", "CASE WHEN doc_id % 4 < 2 THEN 3.0 ELSE 1.0 END AS w")
    taken = defaultdict(int)
    for row in mixing.mix(docs, weight="w").collect():
        taken[row.doc_id % 4 < 2] += row.copies
    assert taken[True] > 2 * taken[False]


def test_query_is_near_its_targets_and_repeats(spark):
    build = queries.QUERIES["op3_source_mixing"]
    rows = build(spark, SF).collect()
    texts = dict(llm_cases.read(SF, "SELECT doc_id, text FROM documents"))
    assert {row.doc_id: row.size for row in rows} == {d: len(t.encode().split()) for d, t in texts.items()}
    check(rows, lambda largest: largest / 2 + 1e-6)
    assert sorted(rows) == sorted(build(spark, SF).collect())
    taken, target = defaultdict(int), {row.source: row.target for row in rows}
    for row in rows:
        taken[row.source] += row.taken
    assert all(abs(taken[source] - wanted) <= 0.01 * wanted for source, wanted in target.items()), {s: (taken[s], t) for s, t in target.items()}
    plan = build(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
