"""Small tables with the awkward cases every corpus operator must take."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # names that operators use inside
                     T.StructField("h", T.StringType()), T.StructField("grp", T.StringType()),
                     T.StructField("spans", T.StringType()), T.StructField("chunks", T.StringType())])
SF = "/root/testdata/sf0.001"


def rows(texts):
    return [(i, t, "en", "s", len(t or ""), "x", "x", "x", "x") for i, t in texts]


def docs(spark, texts):
    """A documents table (with columns of clashing names) from (doc_id, text) pairs."""
    return spark.createDataFrame(rows(texts), DOCS)


def words(n, seed=0, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


AWKWARD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (4, "one two"), (None, "no id at all here"),
           (5, words(30000, 9)), (6, "é" * 700 + "\n" + "日本語 " * 200), (7, "a\x00b \x0b c")]
