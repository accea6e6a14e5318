"""Golden values of two invented exports (4 rows), computed from the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens import operators as op
from adlens.sources import read_exports
from tests.fixtures import (A1, A2, ADS, ADS_A, ADS_B, B1, B2, ENDS, NAME_A, NAME_B, STARTS, total, write_samples)


@pytest.fixture(scope="module")
def ads(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("samples"))
    load = read_exports(spark, write_samples(folder))
    return load.table.persist()


def test_loads_four_rows_typed(ads):
    assert ads.count() == 4
    row = ads.where(F.col("ad_name") == B1["ad_name"]).first()
    assert (str(row.reporting_starts), str(row.reporting_ends)) == (STARTS, ENDS)
    assert row.ends is None                      # "Ongoing"
    assert row.shop_clicks == 0.0                # blank
    assert row.quality_ranking == "-"            # kept
    assert row.ad_set_budget == "By campaign"
    assert row.source_file == NAME_B


def test_kpis(ads):
    k = op.kpis(ads).first()
    assert (k.total_spend, k.total_impressions, k.total_reach) == (652.5, 91500, 17200)
    assert (k.total_link_clicks, k.total_clicks_all, k.total_results) == (1102, 1246, 960)
    assert k.overall_ctr == pytest.approx(1102 / 91500 * 100, rel=1e-12)
    assert k.overall_cpc == pytest.approx(652.5 / 1102, rel=1e-12)
    assert k.overall_cpm == pytest.approx(652.5 / 91500 * 1000, rel=1e-12)
    assert k.overall_cpr == pytest.approx(652.5 / 960, rel=1e-12)


def test_kpi_cards_text(ads):
    c = op.kpi_cards(ads).first()
    assert (c.total_spend, c.total_impressions) == ("$652.50", "91,500")
    assert (c.overall_ctr, c.overall_cpc, c.overall_cpm) == ("1.20%", "$0.59", "$7.13")


def test_daily_series_one_day(ads):
    s = op.daily_series(ads, "reporting_starts").collect()
    assert [str(r.reporting_starts) for r in s] == [STARTS]
    assert s[0].spend == 652.5
    e = op.daily_series(ads, "reporting_ends").collect()
    assert [str(r.reporting_ends) for r in e] == [ENDS]


def test_breakdown_delivery(ads):
    rows = {r.ad_delivery: r for r in op.breakdown(ads, "ad_delivery").collect()}
    for name, own in (("active", [A1, A2, B1]), ("inactive", [B2])):
        r = rows[name]
        assert (r.spend, r.link_clicks, r.impressions, r.results) == tuple(
            total(m, own) for m in ("spend", "link_clicks", "impressions", "results"))
        assert r.ctr_link == pytest.approx(total("link_clicks", own) / total("impressions", own) * 100, rel=1e-12)
        assert r.cost_per_result == pytest.approx(total("spend", own) / total("results", own), rel=1e-12)


def test_funnel(ads):
    f = op.funnel(ads).orderBy("step").collect()
    assert [r.value for r in f] == [91500, 1102, 960]
    assert f[0].pct_initial == 100.0


def test_rank_order(ads):
    assert [r.ad_name for r in op.rank_ads(ads).collect()] == [a["ad_name"] for a in (B1, B2, A1, A2)]


def test_correlation_values(ads):
    r = {(x.metric_a, x.metric_b): x.r for x in op.correlation(ads).collect()}
    for a, b in (("results", "reach"), ("results", "spend"), ("reach", "spend")):
        want = np.corrcoef([x[a] for x in ADS], [x[b] for x in ADS])[0, 1]
        assert r[(a, b)] == pytest.approx(want, abs=1e-9)
    assert r[("shop_clicks", "shop_clicks")] is None
    assert all(v is None for (a, b), v in r.items() if "shop_clicks" in (a, b))
    assert r[("spend", "results")] == r[("results", "spend")]


def test_compare_by_source_file(ads):
    rows = {r.item: r for r in op.compare_kpis(ads, "source_file").collect()}
    for name, own in ((NAME_A, ADS_A), (NAME_B, ADS_B)):
        r = rows[name]
        assert (r.total_spend, r.total_link_clicks, r.total_impressions) == tuple(
            total(m, own) for m in ("spend", "link_clicks", "impressions"))


def test_performers(ads):
    p = op.performers(ads).first()
    assert (p.top_performer, p.bottom_performer) == (B1["ad_name"], A2["ad_name"])


def test_insight_context(ads):
    c = op.insight_context(ads).first()
    assert (c.period_start, c.period_end) == (STARTS, ENDS)
    assert c.total_spend == "$652.50"
    assert c.overall_cost_per_result == "$0.68"
    assert c.top_performer == B1["ad_name"]


def test_source_summary(ads):
    assert {(r.source_file, r.rows) for r in op.source_summary(ads).collect()} == {(NAME_A, 2), (NAME_B, 2)}


def test_scatter_means(ads):
    r = {x.ad_name: x for x in op.scatter(ads).collect()}
    assert r[B1["ad_name"]].cpc_link == pytest.approx(240 / 900, abs=1e-6)
    assert r[B2["ad_name"]].ctr_link == pytest.approx(12 / 1500 * 100)
