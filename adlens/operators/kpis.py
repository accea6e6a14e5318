"""Overall KPIs, funnel and the KPI text of the summary.

Each is a single global aggregate: partial sums per task, one tiny final
merge, no shuffle of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.functions import money, money_plain, percent_plain, ratio_or_zero, ratio_text_or_na, whole

# exact money arithmetic: sums of cents do not depend on the summation order
MONEY = "decimal(24,6)"
# amounts that the decimal holds; beyond them (and for infinite ones) cents no longer show in a double
EXACT_BELOW = 1e15


def money_exact(c: Column) -> Column:
    """The amount as a decimal; null where it is too large, infinite or not a number."""
    return F.when(F.abs(c) < F.lit(EXACT_BELOW), c.cast(MONEY))


def money_rest(c: Column) -> Column:
    """The amounts that :func:`money_exact` leaves out, as doubles."""
    return F.when(~(F.abs(c) < F.lit(EXACT_BELOW)), c)


def money_joined(exact: Column, rest: Column) -> Column:
    """Total of a decimal sum and the double sum of what it left out."""
    exact = exact.cast("double")
    return F.when(rest.isNull(), exact).otherwise(F.coalesce(exact, F.lit(0.0)) + rest)


def money_sum(c: str | Column) -> Column:
    """Sum of a money column as double: exact whatever the partitioning for the
    amounts a decimal holds, plus the double sum of any others, so an infinite
    or huge amount makes the total infinite or huge instead of being lost."""
    c = F.col(c) if isinstance(c, str) else c
    return money_joined(F.sum(money_exact(c)), F.sum(money_rest(c)))


def total(c: str) -> Column:
    """Sum of a measure; 0 for an empty input."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def totals(df: DataFrame) -> DataFrame:
    """A1: one row of the six totals."""
    return df.agg(
        F.coalesce(money_sum("spend"), F.lit(0.0)).alias("total_spend"),
        total("impressions").alias("total_impressions"),
        total("reach").alias("total_reach"),
        total("link_clicks").alias("total_link_clicks"),
        total("clicks_all").alias("total_clicks_all"),
        total("results").alias("total_results"),
    )


def kpis(df: DataFrame) -> DataFrame:
    """A1 + A2: totals and the four overall ratios (ratio of sums, 0 unless
    the denominator is positive)."""
    t = totals(df)
    sp, im, lc, rs = (F.col(c) for c in ("total_spend", "total_impressions",
                                         "total_link_clicks", "total_results"))
    return t.select(
        "*",
        ratio_or_zero(lc, im, 100.0).alias("overall_ctr"),
        ratio_or_zero(sp, lc).alias("overall_cpc"),
        ratio_or_zero(sp, im, 1000.0).alias("overall_cpm"),
        ratio_or_zero(sp, rs).alias("overall_cpr"),
    )


def kpi_cards(df: DataFrame) -> DataFrame:
    """A1 + A2 as the ten display strings of the KPI page."""
    k = kpis(df)
    return k.select(
        money(F.col("total_spend")).alias("total_spend"),
        whole(F.col("total_impressions")).alias("total_impressions"),
        whole(F.col("total_reach")).alias("total_reach"),
        whole(F.col("total_link_clicks")).alias("total_link_clicks"),
        percent_plain(F.col("overall_ctr")).alias("overall_ctr"),
        money_plain(F.col("overall_cpc")).alias("overall_cpc"),
        money_plain(F.col("overall_cpm")).alias("overall_cpm"),
        whole(F.col("total_clicks_all")).alias("total_clicks_all"),
        whole(F.col("total_results")).alias("total_results"),
        money_plain(F.col("overall_cpr")).alias("cost_per_result"),
    )


FUNNEL_STAGES = (("Impressions", "total_impressions"), ("Link Clicks", "total_link_clicks"),
                 ("Results", "total_results"))


def funnel(df: DataFrame) -> DataFrame:
    """(step, stage, value, pct_initial) for impressions -> link clicks ->
    results; pct_initial is the percent of the first stage (null when the
    first stage is 0)."""
    t = totals(df)
    first = F.col(FUNNEL_STAGES[0][1])
    stages = F.array(*[
        F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("stage"), F.col(c).alias("value"))
        for i, (name, c) in enumerate(FUNNEL_STAGES)
    ])
    return (t.select(first.alias("_first"), F.inline(stages))
            .select("step", "stage", "value",
                    F.when(F.col("_first") > 0, F.col("value") / F.col("_first") * F.lit(100.0))
                    .alias("pct_initial")))


def insight_kpis(df: DataFrame) -> DataFrame:
    """The seven KPI strings handed to the summary, with ``N/A`` guards."""
    t = totals(df)
    sp, im, lc, rs = (F.col(c) for c in ("total_spend", "total_impressions",
                                         "total_link_clicks", "total_results"))
    return t.select(
        money(sp).alias("total_spend"),
        whole(im).alias("total_impressions"),
        whole(lc).alias("total_link_clicks"),
        ratio_text_or_na(sp, lc, money_plain).alias("overall_cpc"),
        ratio_text_or_na(lc, im, percent_plain, 100.0).alias("overall_ctr"),
        whole(rs).alias("total_results"),
        ratio_text_or_na(sp, rs, money_plain).alias("overall_cost_per_result"),
    )
