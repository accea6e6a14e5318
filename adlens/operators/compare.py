"""Two-item comparison (A15): KPI cards and daily series for two values of a
dimension, side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.functions import ratio_or_zero
from adlens.operators.kpis import money_sum

COMPARE_DIMS = ("ad_name", "ad_delivery", "source_file")


def _selected(df: DataFrame, dim: str, items: Sequence[str] | None) -> DataFrame:
    """Rows of the two compared items.

    Explicit items become one ``IN`` filter. Without items the first two
    values in sorted order are used: a two-row table (a proven bound, so
    broadcast) semi-joined to the rows. Fewer than two values -> no rows.
    """
    if dim not in COMPARE_DIMS:
        raise ValueError(f"dimension must be one of {COMPARE_DIMS}")
    if items is not None:
        items = list(dict.fromkeys(items))
        if len(items) != 2:
            return df.where(F.lit(False))
        return df.where(F.col(dim).isin(items))
    first_two = (df.select(dim).where(F.col(dim).isNotNull()).distinct()
                 .orderBy(dim).limit(2))
    first_two = (first_two.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy()))
                 .where(F.col("_k") == 2).select(dim))
    return df.join(F.broadcast(first_two), on=dim, how="left_semi")


def compare_kpis(df: DataFrame, dim: str = "ad_name", items: Sequence[str] | None = None) -> DataFrame:
    """One row of KPI totals and ratios per compared item."""
    sel = _selected(df, dim, items)
    agg = sel.groupBy(F.col(dim).alias("item")).agg(
        money_sum("spend").alias("total_spend"),
        F.sum("impressions").alias("total_impressions"),
        F.sum("reach").alias("total_reach"),
        F.sum("link_clicks").alias("total_link_clicks"),
        F.sum("clicks_all").alias("total_clicks_all"),
        F.sum("results").alias("total_results"))
    sp, im, lc, rs = (F.col(c) for c in ("total_spend", "total_impressions",
                                         "total_link_clicks", "total_results"))
    return agg.select(
        "*",
        ratio_or_zero(lc, im, 100.0).alias("overall_ctr"),
        ratio_or_zero(sp, lc).alias("overall_cpc"),
        ratio_or_zero(sp, im, 1000.0).alias("overall_cpm"),
        ratio_or_zero(sp, rs).alias("overall_cpr"),
    ).orderBy("item")


def compare_daily(df: DataFrame, dim: str = "ad_name", items: Sequence[str] | None = None) -> DataFrame:
    """(reporting_starts, item, spend, link_clicks, impressions) per
    observed start day of each item; no gap filling, null days dropped."""
    sel = _selected(df, dim, items).where(F.col("reporting_starts").isNotNull())
    return (sel.groupBy("reporting_starts", F.col(dim).alias("item"))
            .agg(money_sum("spend").alias("spend"),
                 F.sum("link_clicks").alias("link_clicks"),
                 F.sum("impressions").alias("impressions"))
            .orderBy("item", "reporting_starts"))
