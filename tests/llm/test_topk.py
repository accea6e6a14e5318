import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, dim string, qb string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x", "x", "x", "x")
                                  for i, v in rows], SCHEMA)


def brute(rows, k=5, step=5):
    own = {}
    for i, v in rows:
        if i is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        q = [math.floor(float(np.float32(c)) * 256) for c in v]
        own[i] = min(own.get(i, q), q)
    out = []
    for i, q in own.items():
        if i % step == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, w)), j) for j, w in own.items() if j != i and len(w) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, **options):
    got = topk.search(table(spark, rows), F.col("vec_id") % 5 == 0, **options).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


@pytest.mark.parametrize("blocks", [(1024, 8192), (7, 40)])
def test_against_brute_force(spark, blocks):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, .3, (6, 12))
    rows = [(i, (centres[i % 6] + rng.normal(0, .02, 12)).tolist()) for i in range(300)]
    rows += [(1000 + i, centres[0].tolist()) for i in range(60)]  # a hot vector: ties
    assert run(spark, rows, query_block=blocks[0], candidate_block=blocks[1]) == brute(rows)


def test_awkward(spark):
    rows = [(0, [1, 2]), (5, [1, -2.5]), (1, None), (2, []), (3, [1, None]), (4, [float("nan"), 1]), (6, [float("inf"), 1]),
            (None, [1, 1]), (7, [0, 0]), (7, [0, 0]), (-10, [-1e-9, 3]), (8, [1, 2, 3]), (15, [1, 2, 3]), (9, [2, 1]), (9, [1, 1])]
    assert run(spark, rows) == brute(rows)


def test_prunes_without_losing(spark):
    rng = np.random.default_rng(2)
    points = (np.repeat(rng.normal(0, 100, (20, 8)), 100, 0) + rng.normal(0, 1, (2000, 8))).round().astype(np.int64)
    ids = np.arange(2000)
    best, who = topk.dual_tree(points[::20], ids[::20], points, ids, 5)
    for row, q in enumerate(ids[::20]):
        scores = points @ points[q]
        order = [j for j in np.lexsort((ids, -scores)) if j != q][:5]
        assert list(who[row]) == order and list(best[row]) == list(scores[order])


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, [1, 2])]) == []
