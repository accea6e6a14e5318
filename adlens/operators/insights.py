"""Summary tables handed to a downstream assistant.

The assistant call itself is not part of the engine; these operators build
the tables it would receive, over all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.functions import iso_date, money, money_plain, percent_plain, ratio_text_or_na, whole
from adlens.operators.filters import preview
from adlens.operators.kpis import money_exact, money_joined, money_rest

ADS_VIEW = "ads"


def _per_ad(df: DataFrame) -> DataFrame:
    """One row per ad (the null ad is its own group here, so that totals
    cover every row): mean cost per result and the partial totals."""
    return df.groupBy("ad_name").agg(
        F.avg("cost_per_result").alias("_cpr"),
        F.sum(money_exact(F.col("spend"))).alias("_spend"),
        F.sum(money_rest(F.col("spend"))).alias("_spend_rest"),
        F.sum("impressions").alias("_impr"),
        F.sum("link_clicks").alias("_clicks"),
        F.sum("results").alias("_results"),
        F.min("reporting_starts").alias("_start"),
        F.max("reporting_ends").alias("_end"),
    )


def _best(order_by_min: bool):
    key = F.when(F.col("ad_name").isNotNull(), F.struct(F.col("_cpr"), F.col("ad_name")))
    f = F.min_by if order_by_min else F.max_by
    return F.coalesce(f(F.col("ad_name"), key), F.lit("N/A"))


def performers(df: DataFrame) -> DataFrame:
    """One row (top_performer, bottom_performer): the ads with the lowest
    and highest mean cost per result (ties by name); ``N/A`` when empty."""
    return _per_ad(df).agg(_best(True).alias("top_performer"), _best(False).alias("bottom_performer"))


def insight_context(df: DataFrame) -> DataFrame:
    """A16 + A17 + A18 in one row, from one two-level aggregation: per ad
    first, then over the ads (no join of one-row tables).

    Columns: period_start, period_end (``yyyy-MM-dd``, null without dates),
    the seven KPI strings, top_performer, bottom_performer.
    """
    per_ad = _per_ad(df)
    t = per_ad.agg(
        F.min("_start").alias("_start"), F.max("_end").alias("_end"),
        F.coalesce(money_joined(F.sum("_spend"), F.sum("_spend_rest")), F.lit(0.0)).alias("_sp"),
        F.coalesce(F.sum("_impr"), F.lit(0.0)).alias("_im"),
        F.coalesce(F.sum("_clicks"), F.lit(0.0)).alias("_lc"),
        F.coalesce(F.sum("_results"), F.lit(0.0)).alias("_rs"),
        _best(True).alias("top_performer"), _best(False).alias("bottom_performer"),
    )
    sp, im, lc, rs = F.col("_sp"), F.col("_im"), F.col("_lc"), F.col("_rs")
    return t.select(
        iso_date(F.col("_start")).alias("period_start"),
        iso_date(F.col("_end")).alias("period_end"),
        money(sp).alias("total_spend"),
        whole(im).alias("total_impressions"),
        whole(lc).alias("total_link_clicks"),
        ratio_text_or_na(sp, lc, money_plain).alias("overall_cpc"),
        ratio_text_or_na(lc, im, percent_plain, 100.0).alias("overall_ctr"),
        whole(rs).alias("total_results"),
        ratio_text_or_na(sp, rs, money_plain).alias("overall_cost_per_result"),
        "top_performer", "bottom_performer",
    )


def insight_preview(df: DataFrame) -> DataFrame:
    """The five rows shown beside the context record, in the preview's total order."""
    return preview(df, 5)


def register_ads_view(df: DataFrame, name: str = ADS_VIEW) -> str:
    """Expose the (filtered) table to SQL questions as a temp view."""
    df.createOrReplaceTempView(name)
    return name


def highest_ctr_ad(df: DataFrame) -> DataFrame:
    """A20 "Which ad had the highest CTR?": CTR = link clicks / impressions
    x 100 as a ratio of sums per ad; ads without impressions are skipped;
    ties go to the first name."""
    per_ad = (df.where(F.col("ad_name").isNotNull()).groupBy("ad_name")
              .agg(F.sum("link_clicks").alias("_lc"), F.sum("impressions").alias("_im"))
              .where(F.col("_im") > 0)
              .select("ad_name", (F.col("_lc") / F.col("_im") * F.lit(100.0)).alias("ctr")))
    # highest CTR first, then the smallest name
    best = F.min_by(F.struct("ad_name", "ctr"), F.struct(F.negative(F.col("ctr")), F.col("ad_name")))
    return (per_ad.agg(best.alias("_b")).where(F.col("_b").isNotNull())
            .select("_b.ad_name", "_b.ctr"))


def average_spend_per_day(df: DataFrame) -> DataFrame:
    """A20 "What was the average spend per day?": total spend / number of
    distinct observed start days (two-level aggregate, no distinct expand).
    Spend on rows without a start day counts in the total."""
    per_day = df.groupBy("reporting_starts").agg(
        F.sum(money_exact(F.col("spend"))).alias("_s"), F.sum(money_rest(F.col("spend"))).alias("_rest"))
    t = per_day.agg(money_joined(F.sum("_s"), F.sum("_rest")).alias("_total"), F.count("reporting_starts").alias("days"))
    return t.select(
        F.coalesce(F.col("_total"), F.lit(0.0)).alias("total_spend"),
        "days",
        F.when(F.col("days") > 0, F.col("_total") / F.col("days")).alias("avg_spend_per_day"))


def source_summary(df: DataFrame) -> DataFrame:
    """(source_file, rows) of the combined table."""
    return df.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows")).orderBy("source_file")
