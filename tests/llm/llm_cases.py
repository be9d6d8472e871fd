"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

from pyspark.sql import types as T

DOCUMENTS = (
    T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")
)
EXTRA = ("block", "bucket", "piece", "size", "kept", "row", "label", "order", "rank", "target", "n", "id", "a", "b", "text_hash", "copies")


def sentence(seed, words=40, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(words))


def awkward_rows():
    long_text = sentence(99, 20_000)
    near = sentence(1, 60)
    return [
        (0, near, "en", "a", 1), (1, near + " tail", "en", "a", 1), (2, near, "en", "b", 1), (3, near.upper(), "en", None, 1),
        (4, None, "en", "b", None), (5, "", None, "b", 0), (6, " \n\t ", "de", "c", 3), (7, "one two", "de", "c", 7),
        (8, "ONE  two", "fr", "c", 8), (9, long_text, "en", "d", len(long_text)), (10, long_text + " x", None, "d", 1),
        (11, "naïve café 日本語 ﬁ \U0001f600 end", "fr", "a", 1), (11, "naïve café 日本語 ﬁ \U0001f600 end", "fr", "a", 1),
        (None, "no id here", "en", "a", 1), (None, None, None, None, None), (12, "line\nline\nother\nline", "en", "d", 1),
    ] + [(20 + i, sentence(200 + i, 30 + i), ("en", "de")[i % 2], "abc"[i % 3], 1) for i in range(20)]


def frame(spark, rows, extra=True):
    """A documents table; with `extra`, further columns whose names the operators might use themselves."""
    docs = spark.createDataFrame(rows, DOCUMENTS)
    return docs.selectExpr("*", *[f"'x' AS `{name}`" for name in EXTRA]) if extra else docs


def labels_frame(spark, rows):
    return spark.createDataFrame(rows, T.StructType().add("doc_id", "long").add("quality", "integer").add("toxic", "integer"))


def read(folder, sql):
    """Rows of a DuckDB query over the test tables."""
    import duckdb

    connection = duckdb.connect()
    for name in ("documents", "labels", "pages"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection.execute(sql).fetchall()
