"""A12 under filters: quartiles from stored KLL quantile sketches.

:func:`quantile_cells` makes one sketch for each (start day, end day, source file, ad,
campaign, delivery) cell asked for, in one pass and map-side combined; the cells are stored once. A filter
then picks cells, and their sketches merge in the shuffle: no raw value is read or
counted again. A sketch of size ``k`` answers a quantile within a rank error of
:func:`rank_error`, whatever the number of values and however often sketches were
merged; ``box_stats`` stays the exact way.

Values that are not finite are no measurements and are left out, as ``quartiles`` does
with nulls; a group without values gives null quartiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.operators.filters import ALL_DATES, filter_ads

SKETCH_K = 2000
DATES = ("reporting_starts", "reporting_ends")
QUARTILE_RANKS = (("q1", 0.25), ("median", 0.5), ("q3", 0.75))


def rank_error(k: int = SKETCH_K) -> float:
    """The normalised rank error of one quantile of a KLL sketch, held with 99 % confidence (published formula)."""
    return 2.296 / k ** 0.9723


def quantile_cells(df: DataFrame, metric: str = "cpc_link", dims: Sequence[str] = ("ad_delivery",), k: int = SKETCH_K) -> DataFrame:
    """(dates, dims, n, sketch): the sketch of ``metric`` in each cell."""
    finite = ~F.isnan(metric) & (F.abs(F.col(metric)) != float("inf"))
    return df.where(finite).groupBy(*DATES, *dims).agg(
        F.count(metric).alias("n"), F.kll_sketch_agg_double(metric, k).alias("sketch"))


def sketched_quartiles(cells: DataFrame, dim: str = "ad_delivery", date_range=ALL_DATES, k: int = SKETCH_K, **lists) -> DataFrame:
    """(dim, n, q1, median, q3) of the cells that a filter (see :func:`filter_ads`) keeps."""
    kept = filter_ads(cells, date_range=date_range, **lists).where(F.col(dim).isNotNull())
    merged = kept.groupBy(dim).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("_s"))
    return merged.select(dim, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(p)).alias(q) for q, p in QUARTILE_RANKS]).orderBy(dim)


def rank_gaps(df: DataFrame, answers: DataFrame, metric: str = "cpc_link", dim: str = "ad_delivery") -> DataFrame:
    """(dim, n, gap of each quartile): how far the rank of an answer is from the one asked for, by an exact count.

    The rank of a value that is repeated is a range; the gap is 0 within it.
    """
    x = F.col(metric)
    # one row a group: its size is that of the report
    joined = df.where(~F.isnan(x) & (F.abs(x) != float("inf"))).join(F.broadcast(answers.drop("n")), dim)
    counts = joined.groupBy(dim).agg(F.count(x).alias("n"), *[
        f(x, F.col(q)).alias(f"_{side}_{q}") for q, _ in QUARTILE_RANKS for side, f in (
            ("below", lambda x, q: F.count_if(x < q)), ("upto", lambda x, q: F.count_if(x <= q)))])
    gaps = [F.greatest(F.lit(0.0), F.col(f"_below_{q}") / F.col("n") - p, p - F.col(f"_upto_{q}") / F.col("n")).alias(f"gap_{q}")
            for q, p in QUARTILE_RANKS]
    return counts.select(dim, "n", *gaps).orderBy(dim)
