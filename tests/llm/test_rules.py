import math
import re
from collections import Counter

import llm_cases

from gridtide.llm import queries, rules

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force():
    texts = [row[1] for row in llm_cases.awkward_rows()] + ["a b c d e f g h " * 3, "x\r\nx\n\x0bx\n#*$%&|<> é", "a " * 40]
    for text in texts:
        assert rules.text_stats(text)[:5] == brute(text)


def test_binomial_sum_is_exact():
    for n, p in ((10, 0.3), (50, 0.02)):
        for k in range(n):
            exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert abs(rules.binomial_cdf(k, n, p) - exact) < 1e-12
    assert rules.binomial_cdf(5, 5, 0.1) == 1.0


def test_cutoffs_stop_at_the_first_uncertified_value():
    assert rules.strictest((3, 2, 1), [0, 0, 0], 1000, 0.01, 0.001) == 1
    assert rules.strictest((3, 2, 1), [0, 50, 0], 1000, 0.01, 0.001) == 3
    assert rules.strictest((3, 2, 1), [0, 0, 0], 10, 0.01, 0.001) is None


def test_awkward_rows_and_missing_labels(spark):
    docs = llm_cases.frame(spark, llm_cases.awkward_rows())
    none = llm_cases.labels_frame(spark, [])
    rows = rules.judged(docs, none).collect()
    assert len(rows) == len(llm_cases.awkward_rows())
    assert all(row.kept != row.base_failed for row in rows)
    labels = llm_cases.labels_frame(spark, [(0, 1, 0), (0, 0, 0), (1, None, None), (None, 1, 0)])
    assert rules.judged(docs, labels).count() == len(rows)
    assert rules.judged(docs.limit(0), labels).count() == 0


def test_query_counts_and_false_rejections(spark):
    texts = dict(llm_cases.read(SF, "SELECT doc_id, text FROM documents"))
    good = {row[0] for row in llm_cases.read(SF, "SELECT doc_id FROM labels WHERE quality = 1")}
    rows = queries.QUERIES["op6_quality_rules"](spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == brute(texts[row.doc_id])
        assert row.base_failed == (row.n_words < 20 or 100 * row.n_repeat_words > 30 * row.n_words)
        assert not (row.base_failed and row.kept)
    rejected = [row for row in rows if row.doc_id in good and not row.base_failed and not row.kept]
    assert len(rejected) <= 0.02 * len(good)


def test_a_few_hundred_good_documents_certify_the_rules_together(spark):
    # 300 good documents without any symbol in each of four languages; junk with two symbols a word.
    rows = [(i, llm_cases.sentence(i), ("en", "de", "fr", "es")[i % 4], "a", 1) for i in range(1200)]
    junk = [(5000 + i, llm_cases.sentence(i).replace(" ", "## "), ("en", "de", "fr", "es")[i % 4], "a", 1) for i in range(8)]
    few = [(6000 + i, llm_cases.sentence(i), "it", "a", 1) for i in range(100)] + [(7000, junk[0][1], "it", "a", 1)]
    labels = llm_cases.labels_frame(spark, [(row[0], 1, 0) for row in rows + few[:-1]])
    found = {row.doc_id: row for row in rules.judged(llm_cases.frame(spark, rows + junk + few), labels).collect()}
    assert all(found[row[0]].failed_rules == ["symbols_per_word"] for row in junk)
    assert all(found[row[0]].kept for row in rows) and found[7000].kept  # too few labels certify nothing


def test_rule_sets_grow_stricter_one_cutoff_at_a_time():
    sets = rules.rule_sets(rules.GRIDS)
    assert len(sets) == sum(map(len, rules.GRIDS.values())) and sets[-1] == {rule: grid[-1] for rule, grid in rules.GRIDS.items()}
    for before, now in zip([{}, *sets], sets):
        assert len(now.items() - before.items()) == 1 and all(now[rule] <= cutoff for rule, cutoff in before.items())


def test_copies_are_no_new_evidence(spark):
    """60 good documents, each given five times and copied under four further ids, prove as much as 60."""
    rows = [(i, llm_cases.sentence(i), "en", "a", 1) for i in range(60)]
    copies = [(1000 * k + i, text, lang, source, n) for k in range(1, 5) for i, text, lang, source, n in rows]
    labels = llm_cases.labels_frame(spark, [(row[0], 1, 0) for row in rows + copies])
    cutoffs = lambda docs: rules.certified_cutoffs(rules.measured(llm_cases.frame(spark, docs)), labels, risk=0.04, delta=0.1).collect()
    once = cutoffs(rows)
    assert once[0].cut_symbols_per_word is not None
    assert cutoffs(rows * 5) == cutoffs(rows + copies) == once
    assert rules.certified_cutoffs(rules.measured(llm_cases.frame(spark, (rows[:30] + copies[:30]) * 5)), labels, risk=0.04, delta=0.1).collect()[0].cut_symbols_per_word is None
