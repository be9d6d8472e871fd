import hashlib

import llm_cases
from pyspark.sql import functions as F

from gridtide.llm import queries, syncmers

SF = "/root/testdata/sf0.01"


def expected(rows):
    """(doc_id, n_chars, sha256 of the edited text) by the definition."""
    texts = sorted(((d is None, d or 0, t or "", d) for d, t in rows))
    out = []
    for i, (_, _, text, doc) in enumerate(texts):
        following = texts[(i + 1) % len(texts)][2]
        m = len(text) // 4
        edited = text[: len(text) - m] + following[:m]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_next_document_across_pieces(spark):
    rows = [(row[0], row[1]) for row in llm_cases.awkward_rows()]
    docs = llm_cases.frame(spark, llm_cases.awkward_rows())
    found = syncmers.fingerprints(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=repr) == expected(rows)
    for bounds in ([0], [0, 7, 11, 25], sorted({d for d, _ in rows if d is not None})):
        following = syncmers.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", bounds).where("not guest")
        edited = F.expr("concat(substring(text, 1, length(text) - length(text) div 4), substring(next_text, 1, int(length(text) div 4)))")
        got = following.select("doc_id", F.char_length("text").cast("long"), F.sha2(edited, 256)).collect()
        assert sorted(map(tuple, got), key=repr) == expected(rows)
    assert syncmers.fingerprints(docs.limit(0)).count() == 0


def test_likeness_and_short_texts(spark):
    rows = {row.doc_id: row for row in syncmers.fingerprints(llm_cases.frame(spark, llm_cases.awkward_rows())).collect()}
    assert all(0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1 for row in rows.values())
    assert rows[4].fingerprint == rows[5].fingerprint == rows[6].fingerprint == "" and rows[4].near_next == 1
    assert rows[0].fingerprint == rows[2].fingerprint and rows[0].near_next > 0.9
    assert len(rows[7].fingerprint.split(",")) == 1 and rows[9].near_edited > 0.5


def test_selection_depends_on_the_kmer_alone(spark):
    inner = llm_cases.sentence(5, 60)
    texts = [(1, inner), (2, llm_cases.sentence(6, 30) + " " + inner + " " + llm_cases.sentence(7, 30))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one, two = [row.anchors for row in syncmers.with_anchors(docs, "text", "anchors").orderBy("doc_id").collect()]
    assert any(two[i : i + len(one)] == one for i in range(len(two)))
    # Brute force with Spark's own hash of each part.
    words = inner.split()
    pairs = spark.createDataFrame([(i, words[i], words[i + 1]) for i in range(len(words) - 1)], "i long, a string, b string")
    smers = [row.h for row in pairs.orderBy("i").select(F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h")).collect()]
    places = syncmers.K - syncmers.S + 1
    windows = [smers[i : i + places] for i in range(len(smers) - places + 1)]
    assert len(one) == sum(min(w) in (w[0], w[-1]) for w in windows)


def test_query_equals_the_definition_and_is_native(spark):
    docs = llm_cases.read(SF, "SELECT doc_id, text FROM documents")
    frame = queries.QUERIES["op5_syncmer_fingerprints"](spark, SF)
    rows = frame.collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=repr) == expected(docs)
    mean = sum(r.near_edited for r in rows) / len(rows)
    assert mean > 0.5 and sum(r.near_next for r in rows) / len(rows) < 0.05
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan


def test_texts_with_words_have_anchors_and_short_ones_survive_edits(spark):
    texts = [(i, llm_cases.sentence(i, 1 + i % 8, 10_000)) for i in range(160)]
    rows = syncmers.fingerprints(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert all(row.fingerprint and row.near_next < 0.5 for row in rows)
    # A long text in a script without spaces, and a short one, with an edited end.
    long_text = "".join(chr(0x4E00 + i * i % 997) for i in range(400))
    pairs = [(1, long_text, long_text[:360]), (2, "internationalisation of programmes", "internationalisation of programs"), (3, "a b", "a c")]
    df = spark.createDataFrame(pairs, "doc_id long, a string, b string")
    df = syncmers.with_anchors(syncmers.with_anchors(df, "a", "x"), "b", "y")
    near = [row.near for row in df.orderBy("doc_id").select(syncmers.likeness("x", "y").alias("near")).collect()]
    assert near[0] > 0.8 and near[1] > 0.4 and near[2] == 0
