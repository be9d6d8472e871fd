import math
from collections import Counter, defaultdict

import llm_cases

from gridtide.llm import perplexity, queries

SF = "/root/testdata/sf0.01"
ORDER, PAD = perplexity.ORDER, chr(perplexity.PAD)


def brute_model(trained, corpus):
    """Log probability of every n-gram of the corpus by the formulas, from dictionaries."""
    def grams(text):
        padded = PAD * (ORDER - 1) + text
        return [padded[i : i + ORDER] for i in range(len(text))]

    counts = Counter(g for text in trained for g in grams(text))
    tables = {ORDER: {g: counts.get(g, 0) for text in corpus for g in grams(text)}}
    for order in range(ORDER - 1, 0, -1):
        tables[order] = defaultdict(int)
        for gram, c in tables[order + 1].items():
            tables[order][gram[1:]] += c > 0
    p = None
    for order in range(1, ORDER + 1):
        table = tables[order]
        d = perplexity.discounts([sum(c == i for c in table.values()) for i in (1, 2, 3, 4)])
        cut = {g: (0.0 if c == 0 else d[min(c, 3) - 1]) for g, c in table.items()}
        total, left = defaultdict(int), defaultdict(float)
        for gram, c in table.items():
            total[gram[:-1]] += c
            left[gram[:-1]] += cut[gram]
        lower = (lambda g: 1 / (sum(c > 0 for c in tables[1].values()) + 1)) if p is None else (lambda g, p=p: p[g[1:]])
        p = {g: (c - cut[g] + left[g[:-1]] * lower(g)) / total[g[:-1]] if total[g[:-1]] else lower(g) for g, c in table.items()}
    return p, grams


def held(spark, ids):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").where(F.expr(f"pmod(xxhash64(doc_id, 'held'), {perplexity.HELD_BACK}) = 0"))
    return {row.doc_id for row in rows.collect()}


def test_perplexities_equal_the_formulas(spark):
    rows = [(i, llm_cases.sentence(i, 20 + i % 7, 30) + "é"[: i % 2], "en", "a", 1) for i in range(60)] + [(60, "ZZ !! ##", "en", "a", 1)]
    labels = [(i, 1, 0) for i in range(40)] + [(41, 0, 0), (42, 1, 1), (43, 1, 0), (43, 0, 0)]
    back = held(spark, range(40))
    p, grams = brute_model([rows[i][1] for i in range(40) if i not in back], [row[1] for row in rows])
    found = perplexity.judged(llm_cases.frame(spark, rows), llm_cases.labels_frame(spark, labels), ["doc_id"], block_bytes=2000).collect()
    assert len(found) == len(rows)
    for row in found:
        text = rows[row.doc_id][1]
        expected = math.exp(-sum(math.log(p[g]) for g in grams(text)) / len(text))
        assert row.n_tokens == len(text) and abs(row.perplexity - expected) < 1e-4 * expected


def test_probabilities_of_a_context_sum_to_one(spark):
    texts = ["abab", "abba", "bbbb", "aabb"]
    p, _ = brute_model(texts, texts)
    grams = spark.createDataFrame([(g, n) for g, n in Counter(g for t in texts for g in brute_model([], [t])[1](t)).items()], "gram string, n long")
    for row in perplexity.probabilities(grams).collect():
        assert abs(math.exp(row.logp) - p[row.gram]) < 1e-5


def test_awkward_rows(spark):
    docs = llm_cases.frame(spark, llm_cases.awkward_rows())
    for labels in ([], [(i, 1, 0) for i in range(20, 40)], [(0, None, None), (None, 1, 0), (9, 1, None)]):
        frame = llm_cases.labels_frame(spark, labels)
        rows = perplexity.perplexities(docs, frame).collect()
        assert len(rows) == len(llm_cases.awkward_rows())
        assert all(row.kept and row.perplexity is None for row in rows if row.doc_id in (4, 5))
        kept = perplexity.trusted_quality(docs, frame)
        assert kept.columns == docs.columns and kept.count() == sum(row.kept for row in rows)
    assert perplexity.perplexities(docs.limit(0), frame).count() == 0


def test_query_rejects_junk_and_keeps_good_documents(spark):
    labels = {d: (q, t) for d, q, t in llm_cases.read(SF, "SELECT doc_id, quality, toxic FROM labels")}
    rows = queries.QUERIES["op4_perplexity"](spark, SF).collect()
    assert len(rows) == len(llm_cases.read(SF, "SELECT doc_id FROM documents"))
    good = [row.kept for row in rows if labels.get(row.doc_id) == (1, 0)]
    junk = [row.kept for row in rows if labels.get(row.doc_id, (1, 0))[0] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(junk) <= 0.6 * len(junk)


def test_one_threshold_rule_for_every_number_of_documents(spark):
    def limit(n, top):
        # n documents of one language, and 400 of another with the same spread around another median.
        rows = [("de", 100, 6.0 * math.exp(top * i / n)) for i in range(-n, n + 1)] + [("en", 100, 5.0 * math.exp(0.1 * i / 200)) for i in range(-200, 201)]
        frame = spark.createDataFrame([(*row, 0.0) for row in rows], "lang string, n_tokens long, perplexity double, variance double")
        return math.exp(sum(perplexity.thresholds(frame)[0]["de"]))

    # About 1.1 times the median, with few documents as with many; no jump at 200 documents.
    assert all(6.0 * 1.08 < limit(n, 0.1) < 6.0 * 1.11 for n in (5, 50, 99, 100, 300))
    assert abs(limit(99, 0.3) / limit(100, 0.3) - 1) < 0.01 and limit(2000, 0.3) > 6.0 * 1.3


def test_novelty_equals_brute_force():
    for text in ("", "short", "abcdefgh", "abcdefgh" * 3, llm_cases.sentence(1, 3000), "The " * 20_000):
        grams = [text[i : i + perplexity.NOVEL] for i in range(len(text) - perplexity.NOVEL + 1)]
        expected, size = [], perplexity.STRETCH
        while grams and (not expected or size < len(grams) * perplexity.WIDER):
            expected.append(sum(len(set(grams[i : i + size])) for i in range(0, len(grams), size)) / len(grams))
            size *= perplexity.WIDER
        assert perplexity.novelties(text) == expected


def test_query_rejects_repeated_words_and_lines(spark):
    sql = "SELECT doc_id, text FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND length(text) >= 100"
    texts = {d: text for d, text in llm_cases.read(SF, sql)}
    repeating = {d for d, text in texts.items() if len(set(text.split())) < 0.3 * len(text.split())}
    rows = queries.QUERIES["op4_perplexity"](spark, SF).where("kept").select("doc_id").collect()
    assert repeating and not repeating & {row.doc_id for row in rows}
    assert len(set(texts) & {row.doc_id for row in rows}) <= 0.02 * len(texts)


def test_short_texts_are_judged_with_a_wider_threshold(spark):
    good = [(i, llm_cases.sentence(i, 30 + i % 7, 60), "en", "a", 1) for i in range(200)]
    short = [(1000 + i, llm_cases.sentence(i, 4, 60), "en", "a", 1) for i in range(20)] + [(2000, "Qx#zzk | Vjjq", "en", "a", 1)]
    labels = llm_cases.labels_frame(spark, [(row[0], 1, 0) for row in good])
    rows = {row.doc_id: row for row in perplexity.perplexities(llm_cases.frame(spark, good + short), labels).collect()}
    assert not rows[2000].kept and sum(rows[1000 + i].kept for i in range(20)) >= 18
    assert rows[1000].threshold > rows[0].threshold
