"""Benchmark decontamination: size-partitioned MinHash containment search.

Finds the test items of which at least ``threshold`` per cent of the 5-word
shingles stand in a document, however long the document is. Resemblance
sketches of a long document say nothing about a short item inside it, so the
sketch is taken of the *item*: items are partitioned by size, and the items of
a partition keep their ``k`` smallest shingle hashes (bottom-k MinHash), with
``k`` from the partition's upper size bound u as u - ceil(threshold * u) + 1. An item contained at the
threshold misses at most q - ceil(threshold * q) of its q shingles, so at least
one of the ``k`` is in the document: every pair above the threshold becomes a
candidate. Candidates are verified by the exact containment of the shingles
themselves. Built-in functions only.

The document side makes hashes inside each row and explodes them straight into
the join with the items' sketches (a few hashes an item; Spark broadcasts them
only if their measured size allows, else it shuffles both sides). Nothing is
paired that shares no sketch hash.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text with fewer than
five words has its whole word sequence as its one shingle. So an item of fewer
than five words is found only in a document that consists of just these words:
it cannot be found inside a longer document, here or in the query's SQL.

Defined cases: null or empty texts and items have no shingles and match
nothing; rows with a null id take no part; rows that repeat a doc_id (or
item_id) count as one document (item) with the union of their shingles; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import narrow, staged

THRESHOLD = 80
WIDTH = 5
SIZE_RATIO = 1.25  # upper bounds of the size partitions grow by this factor
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lower, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gram_hashes(text: Column) -> Column:
    """Hashes of the shingles of a text (a word is hashed once)."""
    def of(wh: Column) -> Column:
        n = F.size(wh)
        many = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: F.xxhash64(
            *[F.get(wh, i + j) for j in range(WIDTH)]))
        return F.when(n >= WIDTH, many).when(n > 0, F.array(F.xxhash64(wh)))
    return _let(F.transform(words(text), lambda x: F.xxhash64(x)), of)


def gram_texts(text: Column) -> Column:
    """The shingles of a text as text."""
    def of(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(1), n - WIDTH + 1), lambda i: F.array_join(F.slice(w, i, WIDTH), " "))
        return F.when(n >= WIDTH, many).when(n > 0, F.array(F.array_join(w, " ")))
    return _let(words(text), of)


def _exploded(df: DataFrame, id_col: str, grams: Column, name: str) -> DataFrame:
    # the outer form: for the plain one Spark adds a filter that computes the array a second time
    return df.select(id_col, F.explode_outer(grams).alias(name)).where(F.col(name).isNotNull())


def sketches(items: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(item_id, h, need): the ``k`` smallest hashes of each item and how many of them a match holds at least."""
    sets = _exploded(items, "item_id", gram_hashes(F.col("text")), "h").groupBy("item_id").agg(
        F.sort_array(F.collect_set("h")).alias("s"))
    q = F.size("s")
    at_least = lambda n: F.ceil(n * F.lit(threshold) / F.lit(100)).cast("int")
    part = F.ceil(F.log(SIZE_RATIO, q.cast("double")) - F.lit(1e-9))
    upper = F.greatest(q, F.floor(F.pow(F.lit(SIZE_RATIO), part)).cast("int"))
    k = F.least(q, upper - at_least(upper) + 1)
    return (sets.withColumn("k", k).withColumn("need", F.col("k") - (q - at_least(q)))
            .select("item_id", F.greatest("need", F.lit(1)).alias("need"),
                    F.explode(F.slice("s", F.lit(1), F.col("k"))).alias("h")))


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """All (doc_id, item_id) with containment of the item in the document, n_item shingles, n_found of them."""
    docs = narrow(docs, doc_id=id_col, text=text_col).where("doc_id IS NOT NULL")
    items = narrow(items, item_id=item_id_col, text=item_text_col).where("item_id IS NOT NULL")
    sketch = staged(sketches(items, threshold), "decon_sketch")
    hits = _exploded(docs, "doc_id", gram_hashes(F.col("text")), "h").join(sketch, "h")
    pairs = staged(hits.groupBy("doc_id", "item_id", "need").agg(F.countDistinct("h").alias("n"))
                   .where("n >= need").select("doc_id", "item_id"), "decon_pairs")
    return verify(docs, items, pairs, threshold)


def verify(docs: DataFrame, items: DataFrame, pairs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs whose exact containment reaches the threshold."""
    shingles = _exploded(items, "item_id", gram_texts(F.col("text")), "s").distinct()
    sizes = shingles.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    wanted = shingles.join(sizes, "item_id")
    near = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = _exploded(near, "doc_id", gram_texts(F.col("text")), "s")
    found = (texts.join(wanted, "s").join(pairs, ["doc_id", "item_id"], "left_semi")
             .groupBy("doc_id", "item_id", "n_item").agg(F.countDistinct("s").alias("n_found")))
    return found.where(F.col("n_found") * 100 >= F.col("n_item") * threshold).select(
        "doc_id", "item_id", "n_item", "n_found")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no test item (all columns; rows with a null id stay)."""
    hit = staged(search(docs, items, id_col, **options).select(
        F.col("doc_id").alias("__hit_id")).distinct(), "decon_hits")
    return docs.join(hit.hint("merge"), F.col(f"`{id_col}`") == F.col("__hit_id"), "left_anti")


_SHINGLES = """
  SELECT DISTINCT {id}, CASE WHEN len(w) >= 5 THEN unnest(list_transform(range(1, len(w) - 3),
      lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM (SELECT {id}, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table} WHERE {id} IS NOT NULL)
  WHERE len(w) >= 5
  UNION
  SELECT {id}, array_to_string(w, ' ') FROM (SELECT {id}, list_filter(string_split_regex(translate(text,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
      FROM {table} WHERE {id} IS NOT NULL)
  WHERE len(w) BETWEEN 1 AND 4
"""
ORACLE = f"""
WITH b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
d AS ({_SHINGLES.format(id="doc_id", table="documents")}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_item::BIGINT AS n_item, count(*)::BIGINT AS n_found
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 80
"""
