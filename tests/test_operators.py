"""Operators on small hand-made frames, and properties against brute force."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adlens import operators as op
from adlens.schema import AD_SCHEMA, MEASURES

D = dt.date


def frame(spark, rows):
    """Canonical ad table from partial rows (missing measures 0, strings null)."""
    full = []
    for r in rows:
        rec = {}
        for f in AD_SCHEMA.fields:
            v = r.get(f.name)
            if v is None and f.name in MEASURES:
                v = 0.0
            rec[f.name] = v
        full.append(tuple(rec[f.name] for f in AD_SCHEMA.fields))
    return spark.createDataFrame(full, AD_SCHEMA)


SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def test_daily_gap_fill(spark):
    df = frame(spark, [
        dict(reporting_starts=D(2025, 1, 1), spend=1.0),
        dict(reporting_starts=D(2025, 1, 3), spend=2.0),
        dict(reporting_starts=D(2025, 1, 3), spend=3.0),
        dict(reporting_starts=None, spend=100.0),
    ])
    got = [(str(r.reporting_starts), r.spend) for r in op.daily_series(df).collect()]
    assert got == [("2025-01-01", 1.0), ("2025-01-02", 0.0), ("2025-01-03", 5.0)]


def test_daily_all_null_dates_is_empty(spark):
    df = frame(spark, [dict(spend=1.0)])
    assert op.daily_series(df).count() == 0


def test_heatmap_mean_across_years(spark):
    df = frame(spark, [
        dict(reporting_starts=D(2024, 1, 1), spend=10.0),
        dict(reporting_starts=D(2025, 1, 1), spend=30.0),
        dict(reporting_starts=D(2025, 2, 2), spend=5.0),
    ])
    # the matrix is built from the gap-filled daily series, so 2024-02-02
    # (a zero day) and 2025-02-02 (5) are averaged too
    long = {(r.month, r.day): r.spend for r in op.heatmap_long(df).collect()}
    assert long[(1, 1)] == 20.0 and long[(2, 2)] == 2.5 and long[(3, 5)] == 0.0
    assert len(long) == 366
    wide = {r.month: r for r in op.heatmap_wide(df).collect()}
    assert wide[1].d1 == 20.0 and wide[2].d2 == 2.5 and wide[2].d31 == 0.0


def test_breakdown_zero_and_infinite_cost(spark):
    df = frame(spark, [
        dict(ad_name="a", spend=5.0, results=0.0),
        dict(ad_name="b", spend=0.0, results=0.0),
        dict(ad_name="c", spend=-2.0, results=0.0),
        dict(ad_name=None, spend=9.0, results=1.0),
    ])
    got = {r.ad_name: r.cost_per_result for r in op.breakdown(df, "ad_name").collect()}
    assert got == {"a": math.inf, "b": 0.0, "c": -math.inf}


def test_filters(spark):
    df = frame(spark, [
        dict(reporting_starts=D(2025, 1, 1), reporting_ends=D(2025, 1, 5), ad_name="a", source_file="f1",
             campaign="x"),
        dict(reporting_starts=D(2025, 1, 2), reporting_ends=D(2025, 2, 5), ad_name="b", source_file="f2",
             campaign="y"),
        dict(reporting_starts=None, reporting_ends=D(2025, 1, 3), ad_name="c", source_file="f1", campaign=None),
    ])
    assert op.filter_ads(df).count() == 2                       # default range drops null dates
    assert op.filter_ads(df, date_range=None).count() == 3      # no date filter
    assert op.filter_ads(df, date_range=("2025-01-01", "2025-01-31")).count() == 1   # containment
    assert op.filter_ads(df, date_range=("2025-01-01", None)).count() == 3  # one end chosen: no filter
    assert op.filter_ads(df, date_range=None, source_files=[]).count() == 3  # empty list: no filter
    assert op.filter_ads(df, date_range=None, campaigns=["x", "y"]).count() == 2  # nulls never match
    vals = df.sparkSession.createDataFrame([("a",), ("c",)], "v string")
    assert op.filter_ads(df, date_range=None, ads=vals).count() == 2   # semi-join form
    s = op.filter_summary(df, date_range=None, ads=["a"]).first()
    assert (s.kept_rows, s.total_rows) == (1, 3)
    assert [r.ad_name for r in op.options(df, "ad_name").collect()] == ["a", "b", "c"]
    assert op.resolve_campaign(["Ad set", "Campaign"]) == "Ad set"


def test_compare_needs_two_values(spark):
    df = frame(spark, [dict(ad_delivery="active", spend=1.0, reporting_starts=D(2025, 1, 1))])
    assert op.compare_kpis(df, "ad_delivery").count() == 0
    df2 = frame(spark, [dict(ad_delivery=v, spend=1.0, reporting_starts=D(2025, 1, 1))
                        for v in ("c", "a", "b")])
    assert [r.item for r in op.compare_kpis(df2, "ad_delivery").collect()] == ["a", "b"]
    assert op.compare_daily(df2, "ad_delivery", ["a", "c"]).count() == 2


def test_performers_empty_is_na(spark):
    p = op.performers(frame(spark, [])).first()
    assert (p.top_performer, p.bottom_performer) == ("N/A", "N/A")
    c = op.insight_context(frame(spark, [])).first()
    assert c.period_start is None and c.overall_cpc == "N/A" and c.total_spend == "$0.00"


def test_stacked_bands(spark):
    df = frame(spark, [
        dict(reporting_starts=D(2025, 1, 1), ad_name="b", spend=2.0),
        dict(reporting_starts=D(2025, 1, 1), ad_name="a", spend=1.0),
        dict(reporting_starts=D(2025, 1, 2), ad_name="b", spend=4.0),
    ])

    def bands(**options):
        return sorted((str(r.reporting_starts), r.ad_name, r.y0, r.y1) for r in op.stacked(df, **options).collect())
    dense = [("2025-01-01", "a", 0.0, 1.0), ("2025-01-01", "b", 1.0, 3.0),
             ("2025-01-02", "a", 0.0, 0.0), ("2025-01-02", "b", 0.0, 4.0)]
    assert bands(dense=True) == dense
    assert bands() == [b for b in dense if b[2:] != (0.0, 0.0)]  # the same bands without the empty ones
    assert bands(top_n_ads=1) == [("2025-01-01", "b", 0.0, 2.0), ("2025-01-02", "b", 0.0, 4.0)]


def test_infinite_and_huge_amounts_are_not_lost(spark):
    inf = float("inf")
    assert op.kpis(frame(spark, [dict(spend=inf), dict(spend=25.0)])).first().total_spend == inf
    assert op.kpis(frame(spark, [dict(spend=1e20), dict(spend=25.0)])).first().total_spend == 1e20
    assert op.kpis(frame(spark, [dict(spend=0.1)] * 10)).first().total_spend == 1.0
    assert op.kpis(frame(spark, [dict(spend=None)])).first().total_spend == 0.0
    rows = [dict(spend=inf, ad_delivery="a", ad_name="x", reporting_starts=D(2025, 1, 1)),
            dict(spend=1.0, ad_delivery="b", ad_name="y", reporting_starts=D(2025, 1, 1))]
    assert {r.ad_delivery: r.spend for r in op.spend_share(frame(spark, rows)).collect()} == {"a": inf, "b": 1.0}
    assert op.average_spend_per_day(frame(spark, rows)).first().avg_spend_per_day == inf
    assert {r.ad_name: r.y1 for r in op.stacked(frame(spark, rows)).collect()} == {"x": inf, "y": inf}


def test_value_tables_filter_like_lists(spark):
    df = frame(spark, [dict(ad_name="a", source_file="f"), dict(ad_name="b", source_file="f"), dict(ad_name=None, source_file="g")])
    vals = spark.createDataFrame([("a",), ("a",), (None,)], "v string")
    none = vals.where("false")
    for ads, kept in ((vals, 1), (none, 3), (["a"], 1), ([], 3)):
        assert op.filter_ads(df, date_range=None, ads=ads).count() == kept
        s = op.filter_summary(df, date_range=None, ads=ads).first()
        assert (s.kept_rows, s.total_rows) == (kept, 3)
    both = op.filter_summary(df, date_range=None, ads=vals, source_files=["g"]).first()
    assert (both.kept_rows, both.total_rows) == (0, 3)
    assert op.filter_ads(df, date_range=None, ads=vals).columns == df.columns


@given(st.lists(st.tuples(st.sampled_from(["x", "y", "z"]),
                          st.integers(min_value=-5, max_value=50)), min_size=1, max_size=60))
@SETTINGS
def test_quartiles_match_numpy(spark, rows):
    df = frame(spark, [dict(ad_delivery=g, cpc_link=float(v)) for g, v in rows])
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    for method in ("linear", "np_half"):
        got = {r.ad_delivery: r for r in op.box_stats(df, method=method).collect()}
        for g, part in pdf.groupby("g"):
            x = np.sort(part.v.to_numpy(dtype=float))
            n = len(x)
            for name, p in (("q1", .25), ("median", .5), ("q3", .75)):
                pos = (n - 1) * p if method == "linear" else min(max(n * p - 0.5, 0), n - 1)
                lo, hi = math.floor(pos), math.ceil(pos)
                want = x[lo] + (x[hi] - x[lo]) * (pos - lo)
                assert getattr(got[g], name) == pytest.approx(want), (g, method, name)
            q1, q3 = getattr(got[g], "q1"), getattr(got[g], "q3")
            lf, uf = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            inside = x[(x >= lf) & (x <= uf)]
            assert got[g].lower_whisker == inside.min() and got[g].upper_whisker == inside.max()
            assert got[g].n_outliers == int(((x < lf) | (x > uf)).sum())


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 9)), min_size=1, max_size=50))
@SETTINGS
def test_global_row_number_is_a_sort(spark, rows):
    df = spark.createDataFrame(rows, "a int, b int")
    got = [(r.a, r.b, r.rn) for r in op.global_row_number(df, ["a", "b"], "rn").orderBy("rn").collect()]
    assert [g[2] for g in got] == list(range(1, len(rows) + 1))
    assert [(a, b) for a, b, _ in got] == sorted(rows)


@given(st.lists(st.tuples(*[st.floats(-1e3, 1e3, allow_nan=False, width=32)] * 3), min_size=0, max_size=25))
@SETTINGS
def test_correlation_matches_pandas(spark, rows):
    cols = ["results", "reach", "spend"]
    df = frame(spark, [dict(zip(cols, map(float, r))) for r in rows])
    got = {(r.metric_a, r.metric_b): r.r for r in op.correlation(df, cols).collect()}
    want = pd.DataFrame(rows, columns=cols, dtype=float).corr()
    for a in cols:
        for b in cols:
            w = want.loc[a, b]
            g = got[(a, b)]
            if a == b and g is not None:
                assert g == 1.0
            elif (isinstance(w, float) and math.isnan(w)) or g is None:
                # constant column / fewer than two rows: null here
                assert g is None or abs(g) <= 1.0
            else:
                assert g == pytest.approx(w, abs=1e-6)
    assert all(v is None or -1.0 <= v <= 1.0 for v in got.values())


def test_correlation_non_finite_pairwise(spark):
    rows = [dict(results=1.0, reach=2.0, spend=1.0), dict(results=2.0, reach=1.0, spend=2.0),
            dict(results=3.0, reach=4.0, spend=math.inf), dict(results=4.0, reach=3.0, spend=4.5)]
    df = frame(spark, rows)
    got = {(r.metric_a, r.metric_b): r.r for r in op.correlation(df, ["results", "reach", "spend"]).collect()}
    pdf = pd.DataFrame(rows).replace([np.inf, -np.inf], np.nan)
    want = pdf[["results", "reach", "spend"]].corr()
    assert got[("results", "spend")] == pytest.approx(want.loc["results", "spend"])
    assert got[("reach", "spend")] == pytest.approx(want.loc["reach", "spend"])
    assert got[("results", "reach")] == pytest.approx(want.loc["results", "reach"])


@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(["on", "off"]),
                          st.integers(0, 30), st.integers(0, 9)), min_size=1, max_size=40))
@SETTINGS
def test_totals_properties(spark, rows):
    df = frame(spark, [dict(ad_name=a, ad_delivery=d, spend=float(s), link_clicks=float(c),
                            impressions=float(s * 10), reporting_starts=D(2025, 1, 1 + c))
                       for a, d, s, c in rows])
    k = op.kpis(df).first()
    assert k.total_spend == sum(float(r[2]) for r in rows)
    by = op.breakdown(df, "ad_delivery").agg(F.sum("spend")).first()[0]
    assert by == pytest.approx(k.total_spend)
    shares = [r.share for r in op.spend_share(df, "ad_delivery").collect()]
    if k.total_spend:
        assert sum(shares) == pytest.approx(1.0)
    series = op.daily_series(df).collect()
    days = {D(2025, 1, 1 + r[3]) for r in rows}
    assert len(series) == (max(days) - min(days)).days + 1
    assert sum(r.spend for r in series) == pytest.approx(k.total_spend)
    assert op.filter_ads(df, date_range=None).count() == len(rows)


def test_ads_view_answers_the_two_questions(spark):
    df = frame(spark, [
        dict(ad_name="a", link_clicks=5.0, impressions=100.0, spend=10.0, reporting_starts=D(2025, 1, 1)),
        dict(ad_name="b", link_clicks=9.0, impressions=100.0, spend=20.0, reporting_starts=D(2025, 1, 1)),
        dict(ad_name="b", link_clicks=1.0, impressions=100.0, spend=30.0, reporting_starts=D(2025, 1, 2)),
        dict(ad_name="c", link_clicks=5.0, impressions=0.0, spend=1.0, reporting_starts=None),
    ])
    name = op.register_ads_view(df, "ads_test")
    assert spark.sql(f"SELECT count(*) FROM {name}").first()[0] == 4
    top = op.highest_ctr_ad(df).first()
    assert (top.ad_name, top.ctr) == ("a", 5.0)          # tie at 5% -> first name
    avg = op.average_spend_per_day(df).first()
    assert (avg.total_spend, avg.days, avg.avg_spend_per_day) == (61.0, 2, 30.5)


def test_describe_columns(spark):
    df = frame(spark, [])
    d = op.describe_columns(df).collect()
    assert [r.name for r in d][:3] == ["reporting_starts", "reporting_ends", "ad_name"]
    assert d[12].display_name == "Amount spent (USD)" and d[12].data_type == "double"
