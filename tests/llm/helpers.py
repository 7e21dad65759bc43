"""Small awkward tables and plain re-statements to hold operators against."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("keep_id", T.StringType()), T.StructField("__text", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def docs(spark, texts):
    """Documents with columns whose names clash with the operators' own."""
    rows = [(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "en", None, None, 1.0, "x", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(n))


AWKWARD = [None, "", " \n\t", "word", "word", "two words", (3, "word"), (None, "no key"), (None, None), words(20000, 1), "x" * 5000, "é" * 50 + "😀", words(60, 2), words(60, 2), "\u0000 nul ퟿"]
