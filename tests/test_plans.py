"""Plan checks: pruning and pushdown reach the scan, no Python in the
report operators, no single-partition exchange over raw rows."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from adlens import operators as op
from adlens.sources.adapter import ad_report

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def ads(spark):
    return ad_report(spark, SF)


def test_kpis_read_only_needed_columns(ads):
    p = plan(op.kpis(ads))
    schema = [line for line in p.splitlines() if line.startswith("ReadSchema:")][0]
    assert "ad_name" not in schema and "campaign" not in schema
    assert "spend" in schema


def test_filters_pushed_to_scan(ads):
    p = plan(op.filter_ads(ads, date_range=("1996-01-01", "1996-12-31"), ads=["Brand#11"]))
    assert "PushedFilters" in p
    assert "GreaterThanOrEqual(reporting_starts" in p
    assert "In(ad_name" in p or "EqualTo(ad_name" in p


REPORTS = sorted(set(entry.reports.queries()) - {"ingest_nothing"})
# two passes by nature: an aggregate decides what the second pass keeps or centres on
TWO_PASSES = {"compare_kpis", "filter_frame", "filter_frame_summary", "compare_daily",
              "stacked_top5", "union_exports", "spend_share"}


@pytest.mark.parametrize("name", REPORTS)
def test_no_python_and_no_single_partition_raw_exchange(spark, name):
    p = plan(entry.queries()[name](spark, SF))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p
    for i, line in enumerate(p.splitlines()):
        if "SinglePartition" in line and "Exchange" in "".join(p.splitlines()[max(0, i - 4): i + 1]):
            # one task may only receive partial aggregates, a top-k, or rows of an aggregate
            assert "partial_" in p or "TakeOrderedAndProject" in p or "Aggregate" in p


@pytest.mark.parametrize("name", [r for r in REPORTS if not r.startswith(("ingest", "csv_", "save_"))])
def test_passes_over_the_ad_table(spark, name):
    p = plan(entry.queries()[name](spark, SF)).split("===== Subqueries =====")
    scans = [sum(line.startswith("Location:") and "adlens_ad_report" in line for line in part.splitlines()) for part in p]
    # a written aggregate has no scan of the ad table left; subqueries of some reports read it once more
    # (explain lists a scalar subquery once per use)
    assert sum(scans) <= (3 if len(scans) > 1 else 2 if name in TWO_PASSES else 1)


def test_aggregates_are_partial_before_shuffle(ads):
    p = plan(op.breakdown(ads, "ad_name"))
    assert "partial_sum" in p
    assert "hashpartitioning(ad_name" in p
