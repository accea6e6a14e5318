"""Mergeable co-moments of many columns in one pass (the engine of A14).

For every ordered pair (i, j) of columns, over the rows where both are finite: the count, the mean
and the centred square sum of i, and the centred product sum. A batch of rows gives
them by matrix products around the batch's own means; two sets of rows are merged by the
pairwise update, so nothing is lost to large means, and the merge is associative up to rounding:
batches merge in their task, tasks in the shuffle, one row each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.session import ship_package

MERGERS = 16  # tasks that merge the rows of all tasks before the last merge


def of_rows(x: np.ndarray) -> np.ndarray:
    """(6, k, k) moments of a (rows, k) matrix: count, mean, square sum, product sum, least and greatest value."""
    finite = np.isfinite(x)
    m = finite.astype(np.float64)
    centre = np.where(finite, x, 0).sum(axis=0) / np.maximum(m.sum(axis=0), 1)
    d = np.where(finite, x - centre, 0)
    n, s = m.T @ m, d.T @ m  # s[i, j]: sum of i where j is finite too
    some = np.maximum(n, 1)
    k = x.shape[1]
    ends = [np.broadcast_to(f(np.where(finite, x, e), axis=0, initial=e)[:, None], (k, k)) for f, e in ((np.min, np.inf), (np.max, -np.inf))]
    return np.stack([n, centre[:, None] + s / some, (d * d).T @ m - s * s / some, d.T @ d - s * s.T / some, *ends])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The moments of two sets of rows together."""
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    gap = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0)
    weight = a[0] * b[0] / some
    mean = np.where(a[0] > 0, a[1], b[1]) + gap * b[0] / some
    return np.stack([n, mean, a[2] + b[2] + gap * gap * weight, a[3] + b[3] + gap * gap.T * weight,
                     np.minimum(a[4], b[4]), np.maximum(a[5], b[5])])


def correlations(m: np.ndarray) -> list[list[float | None]]:
    """Pearson's r of every pair; null for a constant column, too few rows or values beyond doubles."""
    varies = (m[4] < m[5]).diagonal()
    with np.errstate(all="ignore"):
        r = np.clip(m[3] / np.sqrt(m[2] * m[2].T), -1, 1)
    np.fill_diagonal(r, 1)
    return [[float(r[i, j]) if varies[i] and varies[j] and m[0, i, j] >= 2 and np.isfinite(r[i, j]) else None
             for j in range(len(r))] for i in range(len(r))]


def _rows(part: int, state: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([state.tobytes()], pa.binary())], names=["part", "state"])


def _state(body: bytes, k: int) -> np.ndarray:
    return np.frombuffer(body, np.float64).reshape(6, k, k)


def _of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None
    for batch in batches:
        if batch.num_rows:
            new = of_rows(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64, copy=False))
            state = new if state is None else merged(state, new)
    yield from _rows(TaskContext.get().partitionId(), state)


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for body in batch.column("state"):
                new = _state(body.as_py(), k)
                state = new if state is None else merged(state, new)
        yield from _rows(TaskContext.get().partitionId(), state)
    return run


def _finish(names: Sequence[str]):
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in batch.column("states").to_pylist():
                state = of_rows(np.zeros((0, k)))
                for part in found:
                    state = merged(state, _state(part["state"], k))
                r = correlations(state)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a in names for _ in names]), pa.array([b for _ in names for b in names]),
                     pa.array([x for row in r for x in row], pa.float64())], names=["metric_a", "metric_b", "r"])
    return run


def pairwise_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric_a, metric_b, r) of every ordered pair of ``columns``, in one pass."""
    ship_package(df.sparkSession)
    columns, kind = list(columns), "part int, state binary"
    states = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(_of_batches, kind)
    # in the order of the tasks, so that equal layouts give equal sums
    some = states.repartition(MERGERS, F.col("part") % MERGERS).sortWithinPartitions("part").mapInArrow(_merge(len(columns)), kind)
    last = some.agg(F.sort_array(F.collect_list(F.struct("part", "state"))).alias("states"))  # at most MERGERS rows
    return last.mapInArrow(_finish(columns), "metric_a string, metric_b string, r double")
