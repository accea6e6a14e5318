"""Connected components of an edge table by alternating stars, on joins and
map-side combined minima; nothing is gathered on the driver but one checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (a, b) with a > b: hang neighbours on the least of them."""
    both = edges.union(edges.select("b", "a")) if large else edges
    both = staged(both, "cc_both") if large else both
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return staged(out.where("a <> b").distinct(), "cc_star")


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node with an edge whose component's least node is another."""
    e = staged(edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
               .where("a <> b").distinct(), "cc_edges")
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(mark)
        e = _star(_star(e, large=True), large=False)
