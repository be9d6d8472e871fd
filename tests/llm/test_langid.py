import zlib

import llm_cases

from gridtide.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_letters_only_and_case_do_not_matter():
    assert langid.gram_counts("12 34 .,!") is None
    assert (langid.gram_counts("Ab, cd!") == langid.gram_counts("ab cd")).all()
    assert langid.gram_counts("ab cd").sum() == 16  # per word with its marks: 2 letters, 3 pairs, 2 triples, 1 four


def test_calibration_pieces():
    import numpy as np

    assert langid.rejection_threshold(np.array([0.9, 0.8, 0.7]), np.array([True, True, False]), 0.99) == 0.8
    assert langid.rejection_threshold(np.array([0.9]), np.array([False]), 0.99) == 1.0


def test_awkward_rows(spark):
    docs = llm_cases.frame(spark, llm_cases.awkward_rows())
    model = langid.fit_language_model(docs)
    rows = langid.predicted(docs, model).collect()
    assert len(rows) == len(llm_cases.awkward_rows())
    for row in rows:
        if row.doc_id in (4, 5, 6):
            assert (row.lang_pred, row.score, row.rejected) == ("und", 0.0, True)
        assert 0 <= row.score <= 1 and row.held_out == (row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
    assert langid.predicted(docs.limit(0), langid.fit_language_model(docs.limit(0))).count() == 0
    unlabelled = docs.withColumn("lang", docs.lang.substr(1, 0).cast("string")).na.replace("", None, "lang")
    assert {r.lang_pred for r in langid.predicted(unlabelled, langid.fit_language_model(unlabelled)).collect()} == {"und"}


def test_held_out_accuracy_and_no_leak(spark):
    truth = dict(llm_cases.read(SF, "SELECT doc_id, lang FROM documents"))
    rows = queries.QUERIES["op2_language_id"](spark, SF).collect()
    assert len(rows) == len(truth)
    held = [row for row in rows if row.held_out]
    assert {row.doc_id for row in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(row.lang_pred == truth[row.doc_id] for row in held) >= 0.97 * len(held)
    again = {row.doc_id: row for row in queries.QUERIES["op2_language_id"](spark, SF).collect()}
    assert all(again[row.doc_id] == row for row in rows)
