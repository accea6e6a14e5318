"""Distribution statistics: exact box-plot summary (A12) and the Pearson
correlation matrix of the measures (A14).

Exact quantiles without holding a group in one task
---------------------------------------------------
``percentile`` keeps every distinct value of a group in one aggregation
buffer, which fails when one group holds a third of 100 TB. Here one pass
counts how often each value occurs in each group (ties meet map-side); the
counts are written, range-partitioned on (group, value) so that a hot group is
cut by value, and summed up, which gives the ranks each value holds. Only the
values at the ranks that interpolation needs are kept. ``exact=False`` uses
``percentile_approx`` (mergeable sketch, no shuffle of values) instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.operators.moments import pairwise_correlation
from adlens.schema import MEASURES
from adlens.session import staged_table

QUARTILES = (("q1", 0.25), ("median", 0.5), ("q3", 0.75))


def global_row_number(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """1-based row number of ``df`` in ``order``, computed by a distributed
    range-partitioned sort (no single-partition window). ``df`` is read twice."""
    r = (df.repartitionByRange(*order).sortWithinPartitions(*order)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    parts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    # one row per partition: a proven size bound, so it is broadcast
    offsets = parts.select(
        "_pid", "_first",
        (F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_before"))
    return (r.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.coalesce(F.col("_before"), F.lit(0)) + (F.col("_mid") - F.col("_first")) + 1)
            .drop("_pid", "_mid", "_first", "_before"))


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def value_counts(base: DataFrame, dim: str) -> DataFrame:
    """(dim, x, c): how often each value occurs in each group.

    The only pass over the raw rows. Equal values meet in the tasks already
    (map-side), so a value shared by most rows of a group is one row a task.
    """
    return staged_table(base.groupBy(dim, "x").agg(F.count(F.lit(1)).alias("c")), "value_counts")


def _cumulative(counts: DataFrame, dim: str) -> DataFrame:
    """(dim, x, c, before, n): rows of the group below each value, and in the group.

    The distinct values are range-partitioned on (dim, x), so a hot group is
    cut by value, and summed within each range; the ranges' totals (one row a
    range and group) shift them.
    """
    d = _q(dim)
    ranges = staged_table(counts.repartitionByRange(dim, "x").withColumn("_pid", F.spark_partition_id()), "value_ranges")
    totals = (ranges.groupBy("_pid", dim).agg(F.sum("c").alias("_c"))
              .selectExpr("_pid AS _p", f"{d} AS _d",
                          "coalesce(sum(_c) OVER (PARTITION BY " + d + " ORDER BY _pid "
                          "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _shift",
                          f"sum(_c) OVER (PARTITION BY {d}) AS n"))
    within = ranges.selectExpr("*", f"coalesce(sum(c) OVER (PARTITION BY _pid, {d} ORDER BY x "
                                    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before")
    return (within.join(totals, (F.col("_pid") == F.col("_p")) & (F.col(dim) == F.col("_d")))
            .selectExpr(d, "x", "c", "_shift + _before AS before", "n"))


def _quartiles_exact(counts: DataFrame, dim: str, method: str) -> DataFrame:
    if method not in ("linear", "np_half"):
        raise ValueError("method must be 'linear' or 'np_half'")
    d = _q(dim)
    pos_cols = []
    for name, p in QUARTILES:
        pos = (f"least(greatest((n - 1) * {p}D, 0D), CAST(n - 1 AS DOUBLE))" if method == "linear" else
               f"least(greatest(n * {p}D - 0.5D, 0D), CAST(n - 1 AS DOUBLE))")
        pos_cols += [f"CAST(floor({pos}) AS BIGINT) AS _{name}_lo", f"CAST(ceil({pos}) AS BIGINT) AS _{name}_hi",
                     f"{pos} - floor({pos}) AS _{name}_f"]
    ranks = [f"_{q}_{e}" for q, _ in QUARTILES for e in ("lo", "hi")]
    # a value holds the ranks before .. before + c - 1 of its group
    picked = (_cumulative(counts, dim).selectExpr("*", *pos_cols)
              .groupBy(dim)
              .agg(F.first("n").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"),
                   *[F.expr(f"max(CASE WHEN {t} >= before AND {t} < before + c THEN x END) AS {t}v") for t in ranks],
                   *[F.expr(f"first(_{q}_f) AS _{q}_f") for q, _ in QUARTILES]))
    return picked.selectExpr(
        d, "n", "min", "max",
        *[f"_{q}_lov + (_{q}_hiv - _{q}_lov) * _{q}_f AS {q}" for q, _ in QUARTILES])


def _quartiles_approx(base: DataFrame, dim: str, accuracy: int) -> DataFrame:
    qs = F.percentile_approx("x", [p for _, p in QUARTILES], accuracy)
    return (base.groupBy(dim)
            .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("min"), F.max("x").alias("max"),
                 qs.alias("_q"))
            .select(dim, "n", "min", "max", *[F.col("_q")[i].alias(q) for i, (q, _) in enumerate(QUARTILES)]))


def _base(df: DataFrame, dim: str, metric: str) -> DataFrame:
    return (df.where(F.col(dim).isNotNull() & F.col(metric).isNotNull() & ~F.isnan(metric))
            .select(dim, F.col(metric).alias("x")))


def quartiles(df: DataFrame, dim: str = "ad_delivery", metric: str = "cpc_link",
              method: str = "linear", exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """(dim, n, min, max, q1, median, q3) per group."""
    base = _base(df, dim, metric)
    if exact:
        return _quartiles_exact(value_counts(base, dim), dim, method)
    return _quartiles_approx(base, dim, accuracy)


def _with_fences(q: DataFrame) -> DataFrame:
    iqr = F.col("q3") - F.col("q1")
    return q.select("*", iqr.alias("iqr"),
                    (F.col("q1") - F.lit(1.5) * iqr).alias("lower_fence"),
                    (F.col("q3") + F.lit(1.5) * iqr).alias("upper_fence"))


def _fenced(df: DataFrame, dim: str, metric: str, method: str, exact: bool,
            accuracy: int) -> tuple[DataFrame, DataFrame]:
    """(counts, quartiles with fences), both written once; nothing after
    them reads raw rows (with ``exact=False`` the sketch does, once more)."""
    counts = value_counts(_base(df, dim, metric), dim)
    q = _quartiles_exact(counts, dim, method) if exact else _quartiles_approx(_base(df, dim, metric), dim, accuracy)
    return counts, staged_table(_with_fences(q), "box_quartiles")


def box_stats(df: DataFrame, dim: str = "ad_delivery", metric: str = "cpc_link",
              method: str = "linear", exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Per group n, min, q1, median, q3, max, IQR, fences (1.5 IQR) and
    whiskers (the most extreme values inside the fences).

    ``method='linear'`` interpolates at (n-1)p like SQL ``percentile_cont``;
    ``method='np_half'`` at np+1/2, the box chart's default. Imputed zeros
    are values like any other. One pass over the raw rows: everything is
    read off the written value counts.
    """
    counts, q = _fenced(df, dim, metric, method, exact, accuracy)
    outside = (F.col("x") < F.col("lower_fence")) | (F.col("x") > F.col("upper_fence"))
    whiskers = (counts.join(q.select(dim, "lower_fence", "upper_fence"), dim)
                .groupBy(dim)
                .agg(F.min(F.when(F.col("x") >= F.col("lower_fence"), F.col("x"))).alias("lower_whisker"),
                     F.max(F.when(F.col("x") <= F.col("upper_fence"), F.col("x"))).alias("upper_whisker"),
                     F.sum(F.when(outside, F.col("c")).otherwise(0)).alias("n_outliers")))
    return (q.join(whiskers, dim)
            .select(dim, "n", "min", "q1", "median", "q3", "max", "iqr", "lower_fence", "upper_fence",
                    "lower_whisker", "upper_whisker", "n_outliers")
            .orderBy(dim))


def box_outliers(df: DataFrame, dim: str = "ad_delivery", metric: str = "cpc_link",
                 method: str = "linear", exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """The points drawn outside the whiskers: (dim, value) of every row
    beyond a fence."""
    counts, q = _fenced(df, dim, metric, method, exact, accuracy)
    return (counts.join(q.select(dim, "lower_fence", "upper_fence"), dim)
            .where((F.col("x") < F.col("lower_fence")) | (F.col("x") > F.col("upper_fence")))
            .select(dim, "x", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("_copy"))
            .select(dim, F.col("x").alias(metric)))


# ---------------------------------------------------------------------------
# correlation


def correlation(df: DataFrame, cols: Sequence[str] = MEASURES) -> DataFrame:
    """A14 long form: (metric_a, metric_b, r) for every ordered pair of
    ``cols`` (diagonal included), Pearson's r over the rows where both values
    are finite.

    A column that is constant (or has < 2 finite values) gives null, its
    diagonal too. One pass over the rows: see :mod:`adlens.operators.moments`.
    Built-in ``corr`` would update 91 pairs value by value; matrix products over
    Arrow batches take a fraction of that, which is why this report has a Python step.
    """
    return pairwise_correlation(df, cols)


def correlation_matrix(df: DataFrame, cols: Sequence[str] = MEASURES) -> DataFrame:
    """A14 wide form: one row per measure (in list order) with one column per
    measure; the row label is the ``metric`` column."""
    cols = list(cols)
    long = correlation(df, cols)
    order = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("metric"))
    return (long.groupBy(F.col("metric_a").alias("metric")).pivot("metric_b", cols).agg(F.first("r"))
            .orderBy(order).select("metric", *cols))
