"""Every stage on what the stage before it kept."""

from collections import Counter

import test_mixing
import test_neardup
import test_packing

import corpus_pipeline
from gridtide.functions.sizes import cut_lineage
from gridtide.llm import mixing, pii

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, states = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        states.append(cut_lineage(stage(spark, states[-1], SF)))
        assert states[-1].columns == columns
    rows = [[tuple(row) for row in state.collect()] for state in states]
    raw, good, single, masked, mixed = rows
    assert set(good) <= set(raw) and len(good) >= 0.8 * len(raw)
    component = test_neardup.brute([(row[0], row[1]) for row in good])
    assert sorted(row[0] for row in single) == sorted(d for d, c in component.items() if d == c) and set(single) <= set(good)
    before = {row[0]: row for row in single}
    for row in masked:
        assert row[1] == pii.masked(before[row[0]][1]) and row[4] == len(row[1]) and not [s for s in pii.find_spans(row[1])]
    decisions = mixing.mix(states[3]).collect()
    test_mixing.check(decisions, lambda largest: largest / 2 + 1e-6)
    assert Counter(row[0] for row in mixed) == Counter({row.doc_id: row.copies for row in decisions if row.copies})
    packed = corpus_pipeline.run(spark, SF).collect()
    sequences, total = test_packing.check(packed, [(row[0], row[1]) for row in mixed], 4096)
    assert sequences <= -(-total // 4096) * 1.01 + 1
