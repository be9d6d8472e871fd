"""Quality rules with risk-controlled cutoffs.

Each rule compares one ratio of a document with a cutoff. The cutoffs are chosen on labelled documents: of a fixed
sequence of rule sets, from loose to strict, the last one up to which an exact binomial test shows every time that
the rules of the set together reject at most a given share of good documents of the stratum (language).
Fixed-sequence testing needs no correction inside the sequence; the error level is divided by the number of strata
(Bonferroni), so that with probability 1 - `delta` the rules together reject at most `risk` of the good documents of
every stratum.

A trial is a distinct text: repeated rows and copies prove nothing new. A stratum with too few labelled good documents (under 217 for four strata, a `risk` of 0.02 and a `delta` of 0.05)
certifies no cutoff, and only the base rule judges its documents.
"""

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.functions.sizes import cut_lineage

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"

# Grids of cutoffs from loose to strict; a document fails a rule when its ratio is above the cutoff.
GRIDS = {
    "symbols_per_word": (4.0, 3.0, 2.5, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "repeat_share": (0.3, 0.28, 0.25, 0.22, 0.2, 0.18, 0.15, 0.12, 0.1, 0.08, 0.05),
    "chars_per_word": (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0),
}

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words, window=WINDOW):
    """How many words lie in a window of `window` words that occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    index = {}
    ids = np.fromiter((index.setdefault(word, len(index)) for word in words), dtype=np.int64, count=len(words))
    # Windows get dense numbers by doubling: equal numbers mean equal words, without any hash collision.
    codes, width = ids, 1
    while width < window:
        pairs = codes[: len(codes) - width] * (len(words) + 1) + codes[width:]
        codes = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    counts = np.bincount(codes)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    repeated = counts[codes] > 1
    starts[:n] += repeated
    starts[window : window + n] -= repeated
    return int((np.cumsum(starts[:-1]) > 0).sum())


def text_stats(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines with a word) of a text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()
    bare = data.translate(None, SPACE)
    word_chars = len(text) - (len(data) - len(bare))
    lines = Counter(line for line in data.split(b"\n") if line and not line.isspace())
    n_lines = sum(lines.values())
    return len(words), word_chars, len(bare) - len(bare.translate(None, SYMBOLS)), n_lines - len(lines), repeated_words(words), n_lines


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in STATS]))
def _stats(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(text) for text in texts], columns=STATS).astype("int64")


def measured(docs):
    """Per document: doc_id, lang, a hash of the text and the counts every rule is made of. Null text has no words."""
    return docs.select("doc_id", "lang", F.xxhash64("text").alias("same"), _stats("text").alias("stats")).select("doc_id", "lang", "same", "stats.*")


def base_failed():
    """The fixed rule: under 20 words, or more than 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def ratios():
    """Name to expression of the ratio that each rule limits."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "chars_per_word": F.col("word_chars") / words,
    }


def binomial_cdf(k, n, p):
    """P(X <= k) for X of n trials with chance p, summed exactly in logarithms."""
    if k >= n:
        return 1.0
    steps = np.arange(1, k + 1, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log(n - steps + 1) - np.log(steps))])
    logs += np.arange(k + 1) * math.log(p) + (n - np.arange(k + 1)) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def strictest(grid, rejected, n, risk, delta):
    """The last cutoff of a grid, loosest first, up to which every test shows a false rejection share of at most `risk`.

    `rejected[i]` of `n` good documents lie above `grid[i]`. The test of a cutoff is exact: the upper bound of
    Clopper and Pearson at level `delta` is at most `risk` when P(X <= rejected) <= delta for X ~ B(n, risk).
    None when no cutoff passes.
    """
    chosen = None
    for cutoff, k in zip(grid, rejected):
        if not n or binomial_cdf(k, n, risk) > delta:
            break
        chosen = cutoff
    return chosen


def rule_sets(grids):
    """The fixed sequence of rule sets: rule to cutoff, one more cutoff at each step, all grids at an even pace."""
    steps = sorted((((i + 1) / len(grid), place, rule, cutoff) for place, (rule, grid) in enumerate(grids.items()) for i, cutoff in enumerate(grid)))
    found, current = [], {}
    for _, _, rule, cutoff in steps:
        current = current | {rule: cutoff}
        found.append(current)
    return found


def _added(sets):
    """(rule, cutoff) that each rule set adds to the one before it."""
    return [next(iter(now.items() - before.items())) for before, now in zip([{}, *sets], sets)]


def certified_cutoffs(stats, labels, risk=0.02, delta=0.05, grids=None):
    """Rows (lang, one nullable cutoff per rule) from the documents labelled good.

    The evidence is one aggregate: per stratum the number of good documents that pass the base rule and how many
    of them each rule set rejects. A doc_id with several labels counts as good only if all of them say so. Trials have
    to be independent, so repeated rows are one trial, and so are all documents with one text.
    """
    grids = grids or GRIDS
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = stats.join(good, "doc_id").where(~base_failed())
    sets, values = rule_sets(grids), ratios()
    # A document is rejected from the first step on that has one of its ratios above the cutoff.
    first = F.least(*[F.when(values[rule] > cutoff, F.lit(i)).otherwise(F.lit(len(sets))) for i, (rule, cutoff) in enumerate(_added(sets))])
    rejected = [F.count(F.when(F.col("first") <= i, 1)).alias(f"set_{i}") for i in range(len(sets))]
    documents = held.groupBy("lang", "doc_id").agg(F.min(first).alias("first"), F.min("same").alias("same"))
    trials = documents.groupBy("lang", "same").agg(F.min("first").alias("first"))
    counts = trials.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *rejected).collect()  # one row per language
    rows = []
    for row in counts:
        step = strictest(range(len(sets)), [row[f"set_{i}"] for i in range(len(sets))], row["n"], risk, delta / len(counts))
        picked = {} if step is None else sets[step]
        rows.append((row["lang"], *[picked.get(rule) for rule in grids]))
    schema = T.StructType([T.StructField("stratum", T.StringType())] + [T.StructField(f"cut_{r}", T.DoubleType()) for r in grids])
    return stats.sparkSession.createDataFrame(rows, schema)


def judged(docs, labels, risk=0.02, delta=0.05):
    """Per document the counts, whether the base rule fails, the failed certified rules and the verdict.

    Statistics of all documents are computed once, stored, and read for the evidence and for the verdicts. Null
    lang is a stratum of its own. Repeated rows give repeated rows, extra columns are ignored, an empty table
    gives no rows.
    """
    stats = cut_lineage(measured(docs))
    cutoffs = certified_cutoffs(stats, labels, risk, delta)
    joined = stats.join(cutoffs, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    failed = F.filter(
        F.array(*[F.when(value > F.col(f"cut_{rule}"), F.lit(rule)) for rule, value in ratios().items()]),
        lambda rule: rule.isNotNull(),
    )
    base = base_failed()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return joined.select(*names, base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), failed.alias("failed_rules"))
