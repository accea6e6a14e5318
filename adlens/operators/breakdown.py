"""Per-dimension tables.

All are one hash aggregate on the dimension: partial aggregation in every
task before the shuffle, so a dimension value holding a third of the rows
still sends one partial row per task. Null keys are dropped, as the
reference's group-by does. Presentation order is applied to the small
aggregated result only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.functions import ratio_signed_inf
from adlens.operators.kpis import money_exact, money_joined, money_rest, money_sum
from adlens.operators.stats import global_row_number
from adlens.session import staged_table

BREAKDOWN_DIMS = ("ad_name", "ad_delivery")


def breakdown(df: DataFrame, dim: str = "ad_name") -> DataFrame:
    """Sums of spend, link clicks, impressions, results per ``dim``, and the
    ratio-of-sums CTR and cost per result (0/0 -> 0, x/0 -> +-inf)."""
    agg = (df.where(F.col(dim).isNotNull()).groupBy(dim)
           .agg(money_sum("spend").alias("spend"),
                F.sum("link_clicks").alias("link_clicks"),
                F.sum("impressions").alias("impressions"),
                F.sum("results").alias("results")))
    return (agg.select(
        "*",
        ratio_signed_inf(F.col("link_clicks"), F.col("impressions"), 100.0).alias("ctr_link"),
        ratio_signed_inf(F.col("spend"), F.col("results")).alias("cost_per_result"),
    ).orderBy(dim))


def scatter(df: DataFrame) -> DataFrame:
    """Per ad, unweighted row means of CPC and CTR, sums of spend and
    impressions."""
    return (df.where(F.col("ad_name").isNotNull()).groupBy("ad_name")
            .agg(F.avg("cpc_link").alias("cpc_link"),
                 F.avg("ctr_link").alias("ctr_link"),
                 money_sum("spend").alias("spend"),
                 F.sum("impressions").alias("impressions"))
            .orderBy("ad_name"))


def spend_share(df: DataFrame, dim: str = "ad_delivery") -> DataFrame:
    """(dim, spend, share) with share = spend / total spend (0 when the
    total is 0). The total is a scalar subquery over the aggregated groups,
    evaluated once and inlined as a value (no single-task window)."""
    agg = (df.where(F.col(dim).isNotNull()).groupBy(dim)
           .agg(F.sum(money_exact(F.col("spend"))).alias("_exact"), F.sum(money_rest(F.col("spend"))).alias("_rest")))
    tot = agg.agg(money_joined(F.sum("_exact"), F.sum("_rest"))).scalar()
    spend = money_joined(F.col("_exact"), F.col("_rest"))
    return agg.select(
        dim,
        spend.alias("spend"),
        F.when(tot != 0, spend / tot).otherwise(F.lit(0.0)).alias("share"),
    ).orderBy(dim)


def rank_ads(df: DataFrame, exclude_zero_results: bool = False) -> DataFrame:
    """Ads ranked by mean cost per result, ascending (nulls last, ties
    by ad name), with sums of spend, results and impressions.

    Ads without results have cost per result 0 after coercion and therefore
    rank first, as in the reference; ``exclude_zero_results`` drops them.
    The rank is numbered over the aggregated ads by a distributed sort (no
    single-task window), never over raw rows. The aggregate is written to the
    shared folder first: one pass over the raw rows, and the numbering's two
    uses of it see the same mean to the last bit.
    """
    agg = (df.where(F.col("ad_name").isNotNull()).groupBy("ad_name")
           .agg(F.avg("cost_per_result").alias("cost_per_result"),
                money_sum("spend").alias("spend"),
                F.sum("results").alias("results"),
                F.sum("impressions").alias("impressions")))
    if exclude_zero_results:
        agg = agg.where(F.col("results") > 0)
    order = [F.col("cost_per_result").asc_nulls_last(), F.col("ad_name")]
    return global_row_number(staged_table(agg, "rank_ads"), order, "rank").orderBy("rank")
