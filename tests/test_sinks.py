"""Sinks: CSV report files and the Parquet ad table, and a CSV round trip
through the ingestion."""

import glob
import math

import pytest

from adlens import operators as op
from adlens.sources import (load_ads, read_exports, save_ads, write_correlation_csv, write_correlation_report, write_csv,
                            write_report)
from adlens.sources.adapter import ad_report
from tests.fixtures import write_samples


@pytest.fixture(scope="module")
def ads(spark, tmp_path_factory):
    return read_exports(spark, write_samples(str(tmp_path_factory.mktemp("s")))).table


def _one_csv(folder):
    files = glob.glob(f"{folder}/*.csv")
    assert len(files) == 1
    return open(files[0], encoding="utf-8").read().splitlines()


def test_breakdown_csv_has_display_headers_and_inf(spark, ads, workdir):
    df = op.breakdown(ads.where("ad_name != 'Größenwahn'").withColumn("results", ads.results * 0), "ad_delivery")
    lines = _one_csv(write_csv(df, f"{workdir}/breakdown", single_file=True))
    assert lines[0] == ('Ad delivery,Amount spent (USD),Link clicks,Impressions,Results,'
                        'CTR (link click-through rate),Cost per results')
    assert lines[1].endswith(",inf")


def test_correlation_csv_label_column(spark, ads, workdir):
    lines = _one_csv(write_correlation_csv(op.correlation_matrix(ads), f"{workdir}/corr"))
    assert lines[0].startswith(",Results,Reach,Frequency")
    assert lines[1].startswith("Results,1.0,")
    assert len(lines) == 15


def test_save_and_load_ads(spark, workdir):
    t = ad_report(spark, "/root/testdata/sf0.001")
    p = save_ads(t, f"{workdir}/ads")
    back = load_ads(spark, p)
    assert back.count() == t.count()
    assert back.schema == t.schema


def test_csv_round_trip_through_ingestion(spark, workdir):
    t = ad_report(spark, "/root/testdata/sf0.001").drop("campaign", "source_file")
    write_csv(t, f"{workdir}/exports", single_file=False)
    back = read_exports(spark, [f"{workdir}/exports"]).table.drop("source_file", "campaign")
    assert back.count() == t.count()
    assert back.exceptAll(t).count() == 0 and t.exceptAll(back).count() == 0
    k1, k2 = op.kpis(t).first(), op.kpis(back).first()
    assert k1 == k2 and not math.isnan(k1.total_spend)


def test_number_text_is_the_shortest_plain_text(spark):
    from adlens.sources.sinks import number_text
    values = [12345678.0, 0.0001, 1e-05, 1.5e-7, 1e16, 1.25e300, 123456789012345.6, -0.1, 0.0, -0.0, 1e15, 9.007199254740993e15,
              float("inf"), float("-inf"), float("nan"), None, 5e-324, 100.0, 2 / 3]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.t for r in df.select("i", number_text(df.v).alias("t")).orderBy("i").collect()]
    want = [None if v is None or v != v else repr(v) for v in values]
    assert got[:16] == want[:16] and got[17:] == want[17:]
    assert float(got[16]) == 5e-324


def test_reports_are_named_files(spark, ads, workdir):
    path = write_report(op.daily_series(ads), f"{workdir}/out", "daily_data.csv")
    other = write_correlation_report(op.correlation_matrix(ads), f"{workdir}/out")
    assert path.endswith("/out/daily_data.csv") and other.endswith("/out/correlation_matrix.csv")
    import os
    assert sorted(f for f in os.listdir(f"{workdir}/out") if not f.endswith(".crc")) == ["correlation_matrix.csv", "daily_data.csv"]
    lines = open(f"{workdir}/out/daily_data.csv", encoding="utf-8").read().splitlines()
    assert lines == ["Reporting starts,Amount spent (USD),Link clicks,Impressions,Results", "2024-03-01,652.5,1102.0,91500.0,960.0"]


def test_names_of_the_downloads():
    from adlens.sources import sinks
    assert (sinks.DAILY_CSV, sinks.BREAKDOWN_CSV, sinks.RANKING_CSV, sinks.CORRELATION_CSV) == (
        "daily_data.csv", "breakdown_data.csv", "ranking_table.csv", "correlation_matrix.csv")


def _listing(folder):
    import os
    return sorted(f for f in os.listdir(folder) if not f.endswith(".crc"))


def test_a_failed_write_leaves_the_old_file(spark, workdir, monkeypatch):
    from pyspark.sql import functions as F

    from adlens.sources import sinks
    old = spark.range(3).selectExpr("id", "'old' AS v")
    path = write_report(old, workdir, "t.csv")
    before = open(path).read()
    failing = spark.range(3).select("id", F.raise_error(F.lit("no")).cast("string").alias("v"))
    with pytest.raises(Exception, match="no"):  # a task fails
        write_report(failing, workdir, "t.csv")
    assert open(path).read() == before and _listing(workdir) == ["t.csv"]

    def broken(*_):
        raise OSError("the commit fails")
    with monkeypatch.context() as m:
        m.setattr(sinks, "commit_file", broken)
        with pytest.raises(OSError, match="commit"):
            write_report(spark.range(9).selectExpr("id", "'new' AS v"), workdir, "t.csv")
    assert open(path).read() == before and _listing(workdir) == ["t.csv"]
    write_report(spark.range(1).selectExpr("id", "'new' AS v"), workdir, "t.csv")  # and a good one replaces it
    assert open(path).read() == "id,v\n0,new\n" and _listing(workdir) == ["t.csv"]


def test_a_failed_save_leaves_the_old_table(spark, workdir, monkeypatch):
    from pyspark.sql import functions as F

    from adlens.sources import sinks
    t = ad_report(spark, "/root/testdata/sf0.001")
    path = save_ads(t, f"{workdir}/ads")
    with pytest.raises(Exception, match="no"):  # a task fails
        save_ads(t.withColumn("ad_name", F.raise_error(F.lit("no")).cast("string")), path)
    assert load_ads(spark, path).count() == t.count() and _listing(workdir) == ["ads"]
    plain, calls = sinks._rename, []

    def second_fails(fs, source, target):
        calls.append(source)
        if len(calls) == 2:
            raise OSError("between the renames")
        plain(fs, source, target)
    with monkeypatch.context() as m:
        m.setattr(sinks, "_rename", second_fails)
        with pytest.raises(OSError, match="between"):
            save_ads(t.limit(5), path)
    assert len(calls) == 3 and load_ads(spark, path).count() == t.count() and _listing(workdir) == ["ads"]
    save_ads(load_ads(spark, path).where("ad_name = 'Brand#11'"), path)  # over itself
    assert load_ads(spark, path).count() == t.where("ad_name = 'Brand#11'").count() > 0 and _listing(workdir) == ["ads"]
    with pytest.raises(Exception, match="exist"):
        save_ads(t, path, mode="errorifexists")


def test_exports_are_written_in_parallel_and_undone_together(spark, workdir):
    from adlens.sources import write_exports
    t = spark.range(0, 100, 1, 4).selectExpr("id", "id * 2 AS v")
    paths = write_exports(t, f"{workdir}/in", "big.csv")
    assert _listing(f"{workdir}/in") == [f"big-{i}.csv" for i in range(4)] and len(paths) == 4
    assert spark.read.csv(f"{workdir}/in", header=True).count() == 100
    with pytest.raises(FileExistsError):  # a name is taken: nothing of the new files stays
        write_exports(t.repartition(6), f"{workdir}/in", "big.csv")
    assert _listing(f"{workdir}/in") == [f"big-{i}.csv" for i in range(4)]


def test_one_busy_date_is_split_over_files(spark, workdir):
    t = spark.range(60000).selectExpr("DATE'2024-01-01' AS reporting_starts", "'one ad' AS ad_name", "rand(1) AS spend",
                                      "rand(2) AS b", "rand(3) AS c")
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        assert len(load_ads(spark, save_ads(t, f"{workdir}/busy")).inputFiles()) >= 3
    finally:
        for k in sizes:
            spark.conf.unset(k)
