"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its character n-grams (1 to 4 letters within a word, with a boundary
mark at both ends), hashed into a fixed number of buckets; a linear layer and a softmax follow. Embeddings and
layer are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows. A temperature
fitted on held-back rows calibrates the scores, and the smallest score at which the accepted held-back rows reach
`precision` becomes the rejection threshold.

Prediction needs no embeddings any more: the product of both layers is one logit vector per bucket, so a text
costs one hash per n-gram, one histogram and one small matrix product.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 14
DIMENSIONS = 16
#: Bound of the sample: so many labelled rows of each language on average, chosen by a hash of doc_id and text.
ROWS_PER_LANGUAGE = 600
GRAMS = (1, 2, 3, 4)
UNKNOWN = "und"

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def _letters():
    """Which code points are letters."""
    table = np.zeros(0x110000, dtype=bool)
    table[[code for code in range(0x110000) if chr(code).isalpha()]] = True
    return table


_TABLE = []


def letter_runs(text):
    """Lower-cased code points with every run of other characters as one zero, zeros at both ends; None without letters."""
    if not _TABLE:
        _TABLE.append(_letters())
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    letter = _TABLE[0][codes]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character behind a run stays as the mark
    kept = np.where(letter, codes, 0)[keep]
    return np.concatenate([[0] if kept[0] else [], kept, [0] if kept[-1] else []]).astype(np.uint32)


def gram_counts(text, buckets=BUCKETS):
    """Histogram of the hashed n-grams of a text, or None without letters."""
    codes = letter_runs(text)
    if codes is None:
        return None
    shift, total = np.uint32(32 - int(math.log2(buckets))), np.zeros(buckets, dtype=np.int64)
    mark = codes == 0
    for n in GRAMS:
        size = len(codes) - n + 1
        if size < 1:
            break
        mixed = np.full(size, n * 0x165667B1 & 0xFFFFFFFF, dtype=np.uint32)
        whole = np.ones(size, dtype=bool)
        for i in range(n):
            mixed = (mixed ^ codes[i : i + size]) * _MULTIPLIERS[i]
            mixed ^= mixed >> np.uint32(15)
            if n == 1 or 0 < i < n - 1:
                whole &= ~mark[i : i + size]
        total += np.bincount(((mixed * np.uint32(0x9E3779B1)) >> shift)[whole], minlength=buckets)
    return total


def _softmax(logits):
    logits = logits - logits.max(axis=-1, keepdims=True)
    power = np.exp(logits)
    return power / power.sum(axis=-1, keepdims=True)


def train(examples, labels, n_labels, epochs=6, rate=0.4, seed=7, buckets=BUCKETS, dimensions=DIMENSIONS):
    """Embeddings and layer by stochastic gradient descent over sparse (bucket, share) examples."""
    random = np.random.default_rng(seed)
    embeddings = random.uniform(-1, 1, (buckets, dimensions)) / dimensions
    layer = np.zeros((dimensions, n_labels))
    steps, total = 0, max(1, epochs * len(examples))
    for _ in range(epochs):
        for i in random.permutation(len(examples)):
            ids, shares = examples[i]
            hidden = shares @ embeddings[ids]
            error = _softmax(hidden @ layer)
            error[labels[i]] -= 1
            step = rate * (1 - steps / total)
            back = layer @ error
            layer -= step * np.outer(hidden, error)
            embeddings[ids] -= (step * 8) * np.outer(shares, back)
            steps += 1
    return embeddings, layer


def fit_temperature(logits, labels):
    """The temperature of a fixed grid with the smallest log loss."""
    if not len(labels):
        return 1.0
    rows = np.arange(len(labels))
    loss = {t: -np.log(_softmax(logits / t)[rows, labels] + 1e-12).mean() for t in np.geomspace(0.05, 20, 60)}
    return float(min(loss, key=loss.get))


def rejection_threshold(scores, right, precision):
    """The smallest score from which on at least `precision` of the rows are right; 1 where none is."""
    order = np.argsort(-scores, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= precision)
    return float(scores[order][good[-1]]) if len(good) else 1.0


def _sparse(text):
    counts = gram_counts(text)
    if counts is None:
        return None
    ids = np.flatnonzero(counts)
    return ids, counts[ids] / counts.sum()


class LanguageModel:
    """Bucket logits, labels, temperature and rejection threshold."""

    def __init__(self, labels, logits, temperature, threshold):
        self.labels, self.logits, self.temperature, self.threshold = labels, logits, temperature, threshold

    @classmethod
    def fit(cls, rows, precision=0.99, seed=7):
        """From (text, lang) rows; every fifth row is held back for calibration, each text also gives a short excerpt."""
        names = sorted({lang for _, lang in rows})
        number = {name: i for i, name in enumerate(names)}
        random = np.random.default_rng(seed)
        parts = {False: ([], []), True: ([], [])}
        for i, (text, lang) in enumerate(rows):
            words = text.split()
            start = int(random.integers(0, max(1, len(words))))
            for piece in (text, " ".join(words[start : start + int(random.integers(2, 13))])):
                if (example := _sparse(piece)) is not None:
                    examples, labels = parts[i % 5 == 4]
                    examples.append(example)
                    labels.append(number[lang])
        embeddings, layer = train(*parts[False], max(1, len(names)), seed=seed)
        logits = (embeddings @ layer).astype(np.float32)
        held = np.array([shares @ logits[ids] for ids, shares in parts[True][0]]).reshape(-1, max(1, len(names)))
        truth = np.array(parts[True][1], dtype=int)
        temperature = fit_temperature(held, truth)
        scores = _softmax(held / temperature)
        threshold = rejection_threshold(scores.max(axis=1), scores.argmax(axis=1) == truth, precision) if len(truth) else 0.0
        return cls(names, logits, temperature, threshold)

    def predict(self, text):
        """(label, score, rejected); `und`, 0 and True for a text without letters, or without any learned label."""
        counts = gram_counts(text) if text and self.labels else None
        if counts is None:
            return UNKNOWN, 0.0, True
        scores = _softmax(counts @ self.logits / counts.sum() / self.temperature)
        best = int(scores.argmax())
        return self.labels[best], float(scores[best]), bool(scores[best] < self.threshold)


def held_out():
    """True for rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs, per_language=ROWS_PER_LANGUAGE):
    """A bounded sample of (text, lang) on the driver, about `per_language` rows of each language.

    A first scan counts rows per language without reading texts; the second keeps a row when a hash of its key
    and text falls below its language's share, so no sort is needed and reruns agree.
    """
    usable = docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {row["lang"]: row["count"] for row in usable.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rows = usable.where(chance < F.try_element_at(share, "lang")).select("text", "lang").collect()
    return sorted((row["text"], row["lang"]) for row in rows)


def fit_language_model(docs, per_language=ROWS_PER_LANGUAGE, precision=0.99, seed=7):
    """Train on rows that are not held out."""
    rows = training_sample(docs, per_language)
    order = np.random.default_rng(seed).permutation(len(rows))
    return LanguageModel.fit([rows[i] for i in order], precision, seed)


def predicted(docs, model):
    """Per document: doc_id, held_out, lang_pred, score and `rejected` (the score is below the calibrated threshold).

    Null texts and texts without a letter get `und`, score 0 and rejected. Null doc_id is not held out. Repeated
    rows give repeated rows, extra columns are ignored.
    """
    kind = T.StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    @F.pandas_udf(kind)
    def language(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(text) for text in texts], columns=kind.names)

    return docs.select("doc_id", held_out().alias("held_out"), language("text").alias("found")).select("doc_id", "held_out", "found.*")
