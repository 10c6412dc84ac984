"""Small tables with the awkward rows every operator must take."""

import random

from pyspark.sql import types as T

# extra columns named like the operators' own
CLASHING = ["key", "size", "rate", "sig", "bucket", "h", "n", "row", "part", "seq", "held_out", "score", "label",
            "class", "weight", "index", "host", "page", "digest", "word", "block", "ids", "_doc", "_sig"]

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "the", "or", "in", "es", "ti"]) for _ in range(r.randint(1, 3))) for _ in range(n))


def edge_rows():
    long = words(40_000, 1)
    same = words(80, 2)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "."), (5, long), (6, same), (7, same), (6, same), (None, words(60, 3)),
            (8, "naïve café 東京 \U0001F600 " * 20), (9, "a"), (10, "x" * 5000), (11, "﷐ token = abcdef12345"), (9, words(50, 4))]
    langs = ["en", None, "de"]
    return [(i, t, langs[k % 3], ["b", None, "a", "é"][k % 4], len(t or ""), *["x"] * len(CLASHING))
            for k, (i, t) in enumerate(rows)]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


BENCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()),
                      *[T.StructField(c, T.StringType()) for c in CLASHING]])


def bench(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * len(CLASHING)) for i, t in rows], BENCH)


PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                      T.StructField("html", T.StringType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])


def pages(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], PAGES)
