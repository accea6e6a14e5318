"""Stored sketches, rollups and bitmap indexes answer as the fact table does."""

import contextlib
import io
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from adlens import operators as op
from adlens.sources.adapter import ad_report

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ads(spark):
    """The test ads with nulls and values that are not finite among them."""
    t = ad_report(spark, SF)
    return t.withColumns({
        "ad_name": F.when(F.col("impressions") % 11 != 0, F.col("ad_name")),
        "campaign": F.when(F.col("impressions") % 13 != 0, F.col("campaign")),
        "reporting_ends": F.when(F.col("impressions") % 17 != 0, F.col("reporting_ends")),
        "cpc_link": F.when(F.col("impressions") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("cpc_link"))})


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


FILTERS = [{}, {"date_range": None}, {"date_range": ("1995-01-01", "1996-06-30")},
           {"source_files": ["export_1.csv", "export_2.csv"], "date_range": None}, {"ads": ["Brand#11", "Brand#23"]},
           {"campaigns": [], "ads": ["no such ad"]}]


@pytest.fixture(scope="module")
def rollup(ads):
    return op.build_rollup(ads)


@pytest.mark.parametrize("filters", FILTERS)
@pytest.mark.parametrize("name,dim", [("kpis", None), ("kpi_cards", None), ("funnel", None), ("breakdown", "ad_delivery"),
                                      ("breakdown", "ad_name"), ("spend_share", "campaign")])
def test_rollup_equals_the_facts(ads, rollup, name, dim, filters):
    build = getattr(op, name)
    kept = op.filter_ads(ads, **filters)
    got = rollup.report(name, dim, **filters)
    assert got.collect() == (build(kept, dim) if dim else build(kept)).collect()
    assert "adlens_ad_report" not in plan(got) and "adlens_rollup" in plan(got)


def test_rollup_takes_the_smallest_level_or_the_facts(spark, ads, rollup):
    sizes = [rows for _, rows, _ in rollup.levels]
    assert sizes == sorted(sizes) and len(sizes) == 4
    assert rollup.covering(set()).endswith(rollup.levels[0][2].rsplit("/", 1)[1])
    assert rollup.covering({"ad_name"}) == next(f for d, _, f in rollup.levels if "ad_name" in d)
    few = op.build_rollup(ads, [("ad_delivery",)])
    by_ad = few.report("breakdown", "ad_name", date_range=None)  # no level has it: the fact table answers
    assert "adlens_ad_report" in plan(by_ad) and by_ad.collect() == op.breakdown(ads, "ad_name").collect()
    with pytest.raises(ValueError):
        op.build_rollup(ads, [("spend",)])
    empty = op.build_rollup(ads.where("false"))
    assert empty.report("kpis").collect() == op.kpis(ads.where("false")).collect()


def test_facets(spark, ads):
    index = op.bitmap_index(ads).cache()
    rows = [r.asDict() for r in ads.select("source_file", "ad_name", "campaign", "ad_delivery").collect()]
    r = random.Random(4)
    names = sorted({x["ad_name"] for x in rows if x["ad_name"]})
    for _ in range(6):
        filters = {"source_file": r.choice([None, ["export_1.csv"], ["export_0.csv", "export_3.csv"]]),
                   "ad_name": r.choice([[], r.sample(names, 5), ["nothing"]]), "ad_delivery": r.choice([None, ["active", "inactive"]])}

        def passes(x, skip=None):
            return all(x[c] in v for c, v in filters.items() if v and c != skip)
        kept = op.kept_count(index, filters).first()
        assert tuple(kept) == (sum(map(passes, rows)), len(rows))
        want = Counter((c, x[c]) for x in rows for c in x if x[c] is not None and passes(x, c))
        got = {(g.column, g.value): g.rows for g in op.facet_counts(index, filters).collect()}
        assert got == dict(want)
    empty = op.bitmap_index(ads.where("false"))
    assert tuple(op.kept_count(empty, {"ad_name": ["x"]}).first()) == (0, 0) and op.facet_counts(empty, {}).collect() == []


@pytest.mark.parametrize("filters", FILTERS[:5])
def test_sketched_quartiles_keep_the_rank_error(ads, filters):
    cells = op.quantile_cells(ads, dims=("ad_delivery", "ad_name", "source_file"), k=400)
    answers = op.sketched_quartiles(cells, k=400, **filters)
    gaps = op.rank_gaps(op.filter_ads(ads, **filters), answers).collect()
    finite = op.filter_ads(ads, **filters).where(F.abs("cpc_link") != float("inf"))
    assert {g.ad_delivery: g.n for g in gaps} == {r.ad_delivery: r["count"] for r in finite.groupBy("ad_delivery").count().collect()}
    assert gaps and all(max(g.gap_q1, g.gap_median, g.gap_q3) <= 3 * op.rank_error(400) for g in gaps)
    assert "adlens_ad_report" in plan(cells)
    assert math.isclose(op.rank_error(200), 0.0133, abs_tol=1e-4)


def test_sketches_of_nothing(ads):
    cells = op.quantile_cells(ads.where("false"))
    assert op.sketched_quartiles(cells).collect() == []


def test_correlation_reads_the_table_once(ads):
    p = plan(op.correlation(ads))
    assert sum(line.startswith("Location:") and "adlens_ad_report" in line for line in p.splitlines()) == 1


def test_correlation_is_stable_around_a_large_mean(spark):
    r = random.Random(2)
    rows = [(1e9 + r.random(), 1e9 + r.random()) for _ in range(500)]
    df = spark.createDataFrame([(a, b, a + b) for a, b in rows], "a double, b double, c double").repartition(7)
    got = {(x.metric_a, x.metric_b): x.r for x in op.correlation(df, ["a", "b", "c"]).collect()}
    import numpy as np
    want = np.corrcoef(np.array([(a - 1e9, b - 1e9, a + b - 2e9) for a, b in rows]).T)
    assert abs(got["a", "b"] - want[0, 1]) < 1e-5 and abs(got["a", "c"] - want[0, 2]) < 1e-5


def test_long_value_tables_are_pruned_before_the_join(spark, ads):
    from adlens.operators.filters import bloom_bits, may_contain
    assert (bloom_bits(1), bloom_bits(1000), bloom_bits(10 ** 12)) == (1 << 12, 1 << 14, 1 << 26)
    values = spark.range(20_000).selectExpr("concat('name ', id) AS v").unionByName(
        spark.createDataFrame([("Brand#11",), ("Brand#45",), (None,)], "v string"))
    kept = ads.where(may_contain(values, F.col("ad_name"), 20_002))
    exact = ads.where(F.col("ad_name").isin("Brand#11", "Brand#45"))
    assert exact.exceptAll(kept).isEmpty() and kept.count() < exact.count() + 0.1 * ads.count()
    p = plan(op.filter_ads(ads, date_range=None, ads=values, long_lists=True))
    assert "bit_get" in p or "getbit" in p.lower()
    for filters in ({"ads": values}, {"ads": values, "campaigns": values.where("false")}, {"source_files": values.where("v IS NULL")}):
        got = op.filter_ads(ads, date_range=None, long_lists=True, **filters)
        want = op.filter_ads(ads, date_range=None, **filters)
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()
