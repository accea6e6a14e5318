"""Exact top-k inner-product search: dual-tree search over cover trees.

Vectors are quantised to integers, so scores are exact. Queries and candidates
are dealt into blocks by a hash of their id; every query block meets every
candidate block in a task of its own, which builds a cover tree over each and
walks both together: a pair of nodes is dropped when even its largest possible
score, <a,b> + R_a |b| + R_b |a| + R_a R_b from the centres a, b and covering
radii R, lies below the worst k-th score of the query node's queries. Blocks
hold a fixed number of rows, so tasks stay bounded; their results (k rows a query
and block) meet in a ranking per query.

Of equal vectors within a block only the k + 1 smallest ids can be among the k
best of anybody, so a vector of a third of all rows costs no more than another.

Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part, nor do rows with a null id; only vectors of the query's
length are its candidates; rows that repeat an id are one vector (the smallest,
by components); ties go to the smaller id; an empty table gives no rows; other
columns are ignored. Components must stay below 2**53 / scale in size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.common import narrow, partitions_for, staged

K = 5
SCALE = 256
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
LEAF = 64
RESULT = "query_id long, vec_id long, score long"


class Node:
    """A cover-tree node: ``rows`` (row numbers), a centre among them and the radius that covers them."""

    __slots__ = ("rows", "centre", "radius", "norm", "children", "worst")

    def __init__(self, points: np.ndarray, rows: np.ndarray, leaf: int):
        self.rows, self.centre = rows, points[rows[0]]
        far = np.sqrt(((points[rows] - self.centre) ** 2).sum(1))
        self.radius, self.norm = float(far.max()), float(np.sqrt((self.centre ** 2).sum()))
        self.children: list[Node] = []
        self.worst = -np.inf
        if len(rows) <= leaf or self.radius == 0:
            return
        # a net of half the radius: centres further apart than that, every point within it of one
        reach, rest, small = self.radius / 2, rows, []
        while len(rest):
            near = np.sqrt(((points[rest] - points[rest[0]]) ** 2).sum(1)) <= reach
            group, rest = rest[near], rest[~near]
            if len(group) < leaf // 8:
                small.append(group)  # a node for a handful of points costs more than it can prune
            else:
                self.children.append(Node(points, group, leaf))
            if len(small) >= leaf // 4 and len(self.children) == 0 and len(small) * 2 > len(rows) // leaf:
                small.append(rest)  # no clusters at this scale: cut what is left into plain leaves
                break
        if small:
            loose = np.concatenate(small)
            for at in range(0, len(loose), leaf):
                self.children.append(Node(points, loose[at: at + leaf], leaf))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


def dual_tree(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray,
              k: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best points of each query, best first; missing ones have id -1."""
    exact = np.abs(queries).max(initial=0) * np.abs(points).max(initial=0) * max(1, queries.shape[1]) < 2 ** 53
    kind = np.float64 if exact else np.int64
    q, p = queries.astype(kind), points.astype(kind)
    qf, pf = queries.astype(np.float64), points.astype(np.float64)
    best = np.full((len(q), k), np.iinfo(np.int64).min, np.int64)
    who = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    have = np.zeros(len(q), np.int64)

    def leaf_pair(a: Node, b: Node) -> None:
        scores = _dot(q[a.rows], p[b.rows]).astype(np.int64)
        own = query_ids[a.rows][:, None] == ids[b.rows][None, :]
        useful = (scores >= best[a.rows][:, -1:]) & ~own
        rows = np.flatnonzero(useful.any(1))
        if len(rows):
            at, useful = a.rows[rows], useful[rows]
            s = np.concatenate([best[at], np.where(useful, scores[rows], np.iinfo(np.int64).min)], 1)
            i = np.concatenate([who[at], np.where(useful, ids[b.rows][None, :], np.iinfo(np.int64).max)], 1)
            order = np.lexsort((i, -s.astype(np.float64) if exact else ~s), axis=-1)[:, :k]
            best[at], who[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            have[at] = (who[at] != np.iinfo(np.int64).max).sum(1)
        a.worst = worst(a)

    def worst(a: Node) -> float:
        return float(best[a.rows, -1].min()) if (have[a.rows] >= k).all() else -np.inf

    def walk(a: Node, b: Node) -> None:
        top = float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
        if top * (1 + 1e-9 * np.sign(top)) + 1e-6 < a.worst:
            return
        if not a.children and not b.children:
            leaf_pair(a, b)
        elif b.children and (not a.children or b.radius >= a.radius):
            for child in sorted(b.children, key=lambda c: -float(a.centre @ c.centre) - c.radius * a.norm):
                walk(a, child)
        else:
            for child in a.children:
                walk(child, b)
            a.worst = min(c.worst for c in a.children)

    if len(q) and len(p):
        walk(Node(qf, np.arange(len(q)), leaf), Node(pf, np.arange(len(p)), leaf * 4))
    return best, np.where(who == np.iinfo(np.int64).max, -1, who)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distinct(points: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Rows that hold one of the ``keep`` smallest ids of their vector."""
    order = np.argsort(ids, kind="stable")
    _, inverse = np.unique(points[order], axis=0, return_inverse=True)
    by = np.argsort(inverse.reshape(-1), kind="stable")
    group = inverse.reshape(-1)[by]
    start = np.searchsorted(group, group)
    return order[by[np.arange(len(by)) - start < keep]]


def _search_block(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        queries, query_ids = _matrix(left["v"]), left["vec_id"].to_numpy()
        points, ids = _matrix(right["v"]), right["vec_id"].to_numpy()
        some = _distinct(points, ids, k + 1)
        best, who = dual_tree(queries, query_ids, points[some], ids[some], k)
        row, col = np.nonzero(who >= 0) if (ids >= 0).all() else np.nonzero(best > np.iinfo(np.int64).min)
        return pa.table([query_ids[row], who[row, col], best[row, col]], schema=schema)

    return run


def quantised(x: Column, scale: int = SCALE) -> Column:
    """The vector's components times ``scale``, rounded down; null where it takes no part."""
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when((F.size(x) > 0) & ~bad, F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
           scale: int = SCALE, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The k best (query_id, rank, vec_id, score) of every row that ``is_query`` (an expression over ``vec_id``)."""
    spark = vectors.sparkSession
    rows = narrow(vectors, vec_id=id_col, x=vector_col).select("vec_id", quantised(F.col("x"), scale).alias("v"))
    rows = staged(rows.where("vec_id IS NOT NULL AND v IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v")),
                  "topk_vectors")
    queries = rows.where(is_query)
    n_q = partitions_for(spark, queries.count(), query_block)
    n_c = partitions_for(spark, rows.count(), candidate_block)
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "v", F.size("v").alias("dim"), block(n_q).alias("qb"), every(n_c).alias("cb"))
    right = rows.select("vec_id", "v", F.size("v").alias("dim"), every(n_q).alias("qb"), block(n_c).alias("cb"))
    found = left.groupBy("dim", "qb", "cb").cogroup(right.groupBy("dim", "qb", "cb")).applyInArrow(
        _search_block(k), RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
