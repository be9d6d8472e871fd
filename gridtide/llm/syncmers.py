"""Document fingerprints from closed syncmers, with DataFrame functions only.

The symbols of a text are its words. A k-mer of words is selected when the smallest hash among its inner s-mers
stands at its first or last place: a decision that depends on the k-mer alone, so equal passages give equal
anchors wherever they stand, and an edit changes only the anchors of the k-mers it touches. Texts whose words select
no k-mer (few words, or a script without spaces) are fingerprinted by their characters in the same way, and by all
of them where these select none either. The fingerprint lists
the anchors in text order; likeness is the share of common anchors among all distinct anchors of two texts.
"""

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

K, S = 5, 2
CHAR_K, CHAR_S = 8, 5  # as many s-mers in a k-mer as for words
SPACE = "[\\x20\\x09-\\x0D]+"
PIECE_BYTES = 8 << 20
MOST_PIECES = 1 << 16


def _shifted(array, places, size):
    return [F.slice(array, F.lit(i + 1), size).alias(f"m{i}") for i in range(places)]


def _with_selected(df, hashes, out, k, s):
    """`df` with the anchors of the closed syncmers of an array of symbol hashes; none for fewer than k symbols."""
    inner, places = f"__inner_{out}", k - s + 1
    count = F.greatest(F.size(hashes) - (s - 1), F.lit(0))
    smer = F.arrays_zip(*_shifted(F.col(hashes), s, count))
    df = df.withColumn(inner, F.transform(smer, lambda x: F.xxhash64(*[x[f"m{i}"] for i in range(s)])))
    windows = F.arrays_zip(*_shifted(F.col(inner), places, F.greatest(F.size(inner) - (places - 1), F.lit(0))))
    parts = [f"m{i}" for i in range(places)]

    def closed(x):
        smallest = F.least(*[x[part] for part in parts])
        return (smallest == x[parts[0]]) | (smallest == x[parts[-1]])

    anchors = F.transform(F.filter(windows, closed), lambda x: F.hash(*[x[part] for part in parts]))
    return df.withColumn(out, anchors).drop(inner)


def with_anchors(df, text, out, k=K, s=S):
    """`df` with the array of anchors of column `text`.

    A text whose words select no k-mer has the anchors of its characters, words separated by one space; where these
    select none either, one anchor, the hash of all its words. Only a text without words has none. The steps are
    columns of their own, so that each array is computed once.
    """
    words, hashes, chars, by_word, by_char = (f"__{step}_{out}" for step in ("words", "hashes", "chars", "by_word", "by_char"))
    trimmed = F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))
    split = F.when(trimmed != "", F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>"))
    df = df.withColumn(words, split)
    df = df.withColumn(hashes, F.transform(words, lambda word: F.xxhash64(word)))
    df = _with_selected(df, hashes, by_word, k, s)
    apart = F.when(F.size(by_word) == 0, F.split(F.array_join(words, " "), "")).otherwise(F.array().cast("array<string>"))
    df = df.withColumn(chars, F.transform(apart, lambda char: F.xxhash64(char)))
    df = _with_selected(df, chars, by_char, CHAR_K, CHAR_S)
    whole = F.when(F.size(hashes) > 0, F.array(F.hash(hashes))).otherwise(F.array().cast("array<int>"))
    found = F.when(F.size(by_word) > 0, F.col(by_word)).when(F.size(by_char) > 0, F.col(by_char)).otherwise(whole)
    return df.withColumn(out, found).drop(words, hashes, chars, by_word, by_char)


def fingerprint(anchors):
    """Anchors as text, in text order."""
    return F.array_join(F.col(anchors).cast("array<string>"), ",")


def likeness(a, b):
    """Common anchors over all distinct anchors; 1 for two texts without words."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def piece_bounds(docs, piece_bytes=PIECE_BYTES, most=MOST_PIECES):
    """First doc_id of each piece of the doc_id order: existing ids, ascending; pieces hold about `piece_bytes` of text.

    Beyond `most` pieces they grow instead. One aggregate finds size and smallest id, a second the quantiles.
    """
    size, least = docs.agg(F.sum(F.octet_length("text").cast("long")), F.min("doc_id")).first()
    if least is None:
        return []
    pieces = max(1, min(most, (size or 0) // piece_bytes))
    if pieces == 1:
        return [least]
    cuts = docs.agg(F.percentile_approx("doc_id", [i / pieces for i in range(1, pieces)], 20 * pieces).alias("cuts")).first()["cuts"]
    return sorted({least, *cuts})


def _count_up_to(array, value):
    return F.size(F.filter(array, lambda bound: bound <= value))


def with_next(docs, column, bounds):
    """Rows of `docs` with `piece` and, in `next_<column>`, that column of the document with the next larger doc_id.

    The first document follows the last. Rows with one doc_id are ordered by text, null ids come last. Documents
    are dealt to pieces of the id order; the first document of a piece is also dealt, as a guest, to the piece
    before it, so that every document finds its successor inside its own piece.
    """
    width = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)] or [[]]
    kind = dict(docs.dtypes)["doc_id"]
    nested = F.from_json(F.lit(json.dumps(groups)), f"array<array<{kind}>>")
    heads = F.from_json(F.lit(json.dumps([group[0] for group in groups if group])), f"array<{kind}>")
    last = max(0, len(bounds) - 1)
    group = F.greatest(_count_up_to(heads, F.col("doc_id")), F.lit(1))
    place = (group - 1) * width + F.greatest(_count_up_to(F.element_at(nested, group), F.col("doc_id")), F.lit(1)) - 1
    piece = F.coalesce(F.when(F.col("doc_id").isNotNull(), place), F.lit(last)).cast("int")
    first = F.array_contains(nested[F.floor(F.col("piece") / width).cast("int")], F.col("doc_id")) if bounds else F.lit(False)
    dealt = docs.withColumn("piece", piece)
    home = F.struct("piece", F.lit(False).alias("guest"))
    before = F.struct(F.when(F.col("piece") == 0, F.lit(last)).otherwise(F.col("piece") - 1).cast("int").alias("piece"), F.lit(True).alias("guest"))
    places = F.when(F.coalesce(first, F.lit(False)), F.array(home, before)).otherwise(F.array(home))
    spread = dealt.withColumn("seat", F.explode(places)).withColumn("piece", F.col("seat.piece")).withColumn("guest", F.col("seat.guest")).drop("seat")
    return spread.withColumn(f"next_{column}", F.lead(column).over(_order()))


def _order():
    return Window.partitionBy("piece").orderBy("guest", F.col("doc_id").asc_nulls_last(), "text")


def fingerprints(docs, k=K, s=S):
    """Per document the fingerprint of its text and of an edited text, and their likeness.

    The edited text ends, in place of its last quarter, with the first as many code points of the next document by
    doc_id. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null
    text counts as empty. Repeated rows give repeated rows (each is the next document of another), extra columns
    are ignored, an empty table gives no rows, a single document is its own successor.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, "text", piece_bounds(docs))
    length = F.char_length("text")
    quarter = F.floor(length / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), length - quarter), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter))
    rows = rows.withColumn("edited", edited).drop("next_text")
    rows = with_anchors(rows, "text", "anchors", k, s)
    rows = rows.withColumn("next_anchors", F.lead("anchors").over(_order())).where(~F.col("guest"))
    rows = with_anchors(rows, "edited", "edited_anchors", k, s)
    return rows.select(
        "doc_id",
        length.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("anchors").alias("fingerprint"),
        fingerprint("edited_anchors").alias("edited_fingerprint"),
        likeness("anchors", "edited_anchors").alias("near_edited"),
        likeness("anchors", F.coalesce("next_anchors", F.array().cast("array<int>"))).alias("near_next"),
    )
