"""Canonical schema of the ad-report fact table.

Every operator in the package reads one typed table whose columns use the
snake-case names below. Display headers (the ones found in export files)
are mapped to and from those names by the ingestion and the sinks.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values (must equal the export format's headers exactly) -------
# The 26 mandatory export headers, in the order the export format lists them.
REQUIRED_COLUMNS: tuple[str, ...] = (
    "Reporting starts", "Reporting ends", "Ad name", "Ad delivery",
    "Attribution setting", "Results", "Result indicator", "Reach", "Frequency",
    "Cost per results", "Ad set budget", "Ad set budget type", "Amount spent (USD)",
    "Ends", "Quality ranking", "Engagement rate ranking", "Conversion rate ranking",
    "Impressions", "CPM (cost per 1,000 impressions) (USD)", "Link clicks",
    "shop_clicks", "CPC (cost per link click) (USD)", "CTR (link click-through rate)",
    "Clicks (all)", "CTR (all)", "CPC (all) (USD)",
)

# The 14 numeric measures, in the export format's measure order.
MEASURE_HEADERS: tuple[str, ...] = (
    "Results", "Reach", "Frequency", "Cost per results", "Amount spent (USD)",
    "Impressions", "CPM (cost per 1,000 impressions) (USD)", "Link clicks",
    "shop_clicks", "CPC (cost per link click) (USD)", "CTR (link click-through rate)",
    "Clicks (all)", "CTR (all)", "CPC (all) (USD)",
)

DATE_HEADERS: tuple[str, ...] = ("Reporting starts", "Reporting ends", "Ends")
RANKING_HEADERS: tuple[str, ...] = (
    "Quality ranking", "Engagement rate ranking", "Conversion rate ranking",
)
# Optional campaign column: the first of these present in the table is used.
CAMPAIGN_HEADERS: tuple[str, ...] = ("Campaign name", "Ad set name", "Ad set", "Campaign")
SOURCE_FILE_HEADER = "Source File"
RANKING_FILL = "N/A"

# Text the export reader treats as missing (the pandas CSV default NA set).
NA_TOKENS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# --- end of fixed values ----------------------------------------------------

# display header -> internal column name
SNAKE: dict[str, str] = {
    "Reporting starts": "reporting_starts",
    "Reporting ends": "reporting_ends",
    "Ad name": "ad_name",
    "Ad delivery": "ad_delivery",
    "Attribution setting": "attribution_setting",
    "Results": "results",
    "Result indicator": "result_indicator",
    "Reach": "reach",
    "Frequency": "frequency",
    "Cost per results": "cost_per_result",
    "Ad set budget": "ad_set_budget",
    "Ad set budget type": "ad_set_budget_type",
    "Amount spent (USD)": "spend",
    "Ends": "ends",
    "Quality ranking": "quality_ranking",
    "Engagement rate ranking": "engagement_ranking",
    "Conversion rate ranking": "conversion_ranking",
    "Impressions": "impressions",
    "CPM (cost per 1,000 impressions) (USD)": "cpm",
    "Link clicks": "link_clicks",
    "shop_clicks": "shop_clicks",
    "CPC (cost per link click) (USD)": "cpc_link",
    "CTR (link click-through rate)": "ctr_link",
    "Clicks (all)": "clicks_all",
    "CTR (all)": "ctr_all",
    "CPC (all) (USD)": "cpc_all",
    SOURCE_FILE_HEADER: "source_file",
}
DISPLAY: dict[str, str] = {v: k for k, v in SNAKE.items()}
DISPLAY["campaign"] = "Campaign name"

MEASURES: tuple[str, ...] = tuple(SNAKE[h] for h in MEASURE_HEADERS)
DATES: tuple[str, ...] = tuple(SNAKE[h] for h in DATE_HEADERS)
RANKINGS: tuple[str, ...] = tuple(SNAKE[h] for h in RANKING_HEADERS)
DATE_AXES: tuple[str, ...] = ("reporting_starts", "reporting_ends")

# the four measures of the time-series tab, in display order
SERIES_METRICS: tuple[str, ...] = ("spend", "link_clicks", "impressions", "results")


def _field(name: str) -> T.StructField:
    if name in DATES:
        return T.StructField(name, T.DateType(), True)
    if name in MEASURES:
        return T.StructField(name, T.DoubleType(), False)
    return T.StructField(name, T.StringType(), True)


# canonical typed table: the 26 required columns, provenance, campaign
AD_SCHEMA = T.StructType(
    [_field(SNAKE[h]) for h in REQUIRED_COLUMNS]
    + [T.StructField("source_file", T.StringType(), True),
       T.StructField("campaign", T.StringType(), True)]
)
AD_COLUMNS: tuple[str, ...] = tuple(f.name for f in AD_SCHEMA.fields)
