from adlens.operators.breakdown import breakdown, rank_ads, scatter, spend_share
from adlens.operators.compare import compare_daily, compare_kpis
from adlens.operators.facets import bitmap_index, facet_counts, kept_count
from adlens.operators.filters import (ALL_DATES, date_bounds, describe_columns, filter_ads,
                                      filter_summary, options, preview, resolve_campaign)
from adlens.operators.insights import (average_spend_per_day, highest_ctr_ad, insight_context,
                                       insight_preview, performers, register_ads_view, source_summary)
from adlens.operators.kpis import funnel, insight_kpis, kpi_cards, kpis, totals
from adlens.operators.rollup import Rollup, build_rollup
from adlens.operators.sketches import quantile_cells, rank_error, rank_gaps, sketched_quartiles
from adlens.operators.stats import (box_outliers, box_stats, correlation, correlation_matrix,
                                    global_row_number, quartiles)
from adlens.operators.timeseries import (daily_long, daily_series, heatmap_long, heatmap_wide,
                                         spend_by_ad, spend_by_ad_dense, stacked, top_ads)

__all__ = [
    "breakdown", "rank_ads", "scatter", "spend_share", "compare_daily", "compare_kpis",
    "ALL_DATES", "date_bounds", "describe_columns", "filter_ads", "filter_summary", "options",
    "preview", "resolve_campaign", "average_spend_per_day", "highest_ctr_ad", "insight_context", "insight_preview",
    "performers", "register_ads_view", "source_summary", "funnel", "insight_kpis", "kpi_cards",
    "kpis", "totals", "box_outliers", "box_stats", "correlation", "correlation_matrix",
    "global_row_number", "quartiles", "daily_long", "daily_series", "heatmap_long",
    "bitmap_index", "facet_counts", "kept_count", "Rollup", "build_rollup", "quantile_cells", "rank_error", "rank_gaps",
    "sketched_quartiles", "heatmap_wide", "spend_by_ad", "spend_by_ad_dense", "stacked", "top_ads",
]
