"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def words(n, seed, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


BASE = words(120, 1)
TEXTS = [
    (0, BASE), (1, BASE), (2, BASE.replace("w1 ", "x1 ", 1)), (3, words(80, 2)), (4, None), (5, ""), (6, "  \t\n "), (7, "one two three"), (8, "one two three"), (9, "One TWO three"),
    (10, "short"), (11, words(3000, 3)), (12, "para one\npara two\npara one\n\n\n" * 8), (13, "é" * 50 + " 日本語 ẞ 𝒳𝒴 " + words(30, 4)), (14, words(60, 5) + " " + " ".join(BASE.split()[:30])),
    (15, "# * $ % & | < > " * 6 + words(20, 6)), (16, words(40, 7).upper()), (17, words(119, 8)), (17, words(119, 8)), (17, words(30, 9)), (20, "a" * 40000 + " tail of words"),
]


def rows(texts=None):
    return [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in (TEXTS if texts is None else texts)]


def documents(spark, texts=None, n=3):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(n)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def written_tables(spark, folder, texts=None, labels=(), conversations=()):
    """A folder like a test data folder."""
    documents(spark, texts).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(conversations), "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    return str(folder)


def clashing(df):
    """df with more columns, named as operators name their own."""
    from pyspark.sql import functions as F

    extra = ["key", "size", "v", "n", "band", "bits", "shard", "vslot", "length", "salt", "rank", "base", "found", "both", "rate", "clean", "component", "ids", "part", "at", "own", "also", "bucket", "grams", "m", "id", "k", "__id", "__seen", "__rate", "secrets", "seq", "segment", "word", "row", "score", "n_tokens", "mean_score", "mixing rate", "c", "part", "i", "j", "a", "b", "e"]
    return df.withColumns({c: F.lit("other") for c in extra})
