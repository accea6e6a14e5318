"""What a task holds, and the plan of a step, do not change with the size of the tables."""

import contextlib
import glob
import io
import re
import time

from pyspark.sql import functions as F

from adlens import operators as op
from adlens.operators import facets, rollup
from adlens.sources import adapter, read_exports, sinks, write_csv
from adlens.sources.adapter import ad_report


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def tables(spark, folder):
    orders = spark.range(40).selectExpr("id AS o_orderkey", "date_add(DATE'2024-01-01', int(id % 3)) AS o_orderdate")
    part = spark.range(8).selectExpr("id AS p_partkey", "concat('Brand#', id % 3) AS p_brand", "concat('TYPE ', id) AS p_type")
    items = spark.range(200).selectExpr(
        "id % 40 AS l_orderkey", "id % 8 AS l_partkey", "int(id % 5 + 1) AS l_linenumber", "double(id % 7 + 1) AS l_quantity",
        "double(id) + 0.25 AS l_extendedprice", "double(id % 3) / 100 AS l_discount", "element_at(array('A', 'N', 'R'), int(id % 3 + 1)) AS l_returnflag")
    for name, df in (("orders", orders), ("part", part), ("lineitem", items)):
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_staging_shuffles_what_the_columns_are_made_of(spark, workdir, monkeypatch):
    sf = tables(spark, f"{workdir}/t")
    assert "BroadcastHashJoin" not in plan(adapter.ad_report_plan(spark, sf))  # small or large: one plan
    assert adapter._partitions(spark, sf) is None
    monkeypatch.setattr(adapter, "BYTES_A_PARTITION", 200)
    n = adapter._partitions(spark, sf)
    assert n > 4  # the session's number
    dealt = adapter.spread(adapter._base(spark, sf, n), "reporting_starts", partitions=n)
    assert len(dealt.columns) == 9 and plan(dealt).count(f", {n}), REPARTITION_BY_NUM") == 5
    staged, want = ad_report(spark, sf), adapter.ad_report_plan(spark, sf)
    assert staged.dtypes == want.dtypes and staged.count() == 200
    assert staged.exceptAll(want).isEmpty() and want.exceptAll(staged).isEmpty()


def test_exports_are_files_of_bounded_rows(spark, workdir, monkeypatch):
    monkeypatch.setattr(sinks, "ROWS_A_FILE", 60)
    ads = ad_report(spark, tables(spark, f"{workdir}/t")).coalesce(1)
    write_csv(ads.drop("source_file"), f"{workdir}/csv")
    assert len(glob.glob(f"{workdir}/csv/*.csv")) == 4
    back = read_exports(spark, [f"{workdir}/csv"]).table.drop("source_file")
    assert back.exceptAll(ads.drop("source_file")).isEmpty() and back.count() == 200
    assert len(glob.glob(f"{write_csv(ads, f'{workdir}/one', single_file=True)}/*.csv")) == 1


def test_number_rules_are_not_fused_into_one_method(spark, workdir):
    """The rules of fourteen numbers in one generated method are too long for the JVM to compile."""
    ads = ad_report(spark, tables(spark, f"{workdir}/t"))
    texts = sinks.with_display_headers(ads)
    write_csv(ads, f"{workdir}/csv")
    typed = read_exports(spark, [f"{workdir}/csv"]).table
    for df in (texts, typed):  # operators without an asterisk are compiled piece by piece
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain()
        assert any(line.lstrip("+- :").startswith("Project") and "transform(" in line for line in out.getvalue().splitlines())


def test_number_text_of_the_common_range(spark):
    given = {0.001: "0.001", 0.002: "0.002", 0.01: "0.01", 12.5: "12.5", 100.0: "100.0", -20.0: "-20.0", 9999999.5: "9999999.5",
             1e7: "10000000.0", 0.0001: "0.0001", 0.00099: "0.00099", 1e16: "1e+16", 0.0: "0.0", float("inf"): "inf"}
    df = spark.createDataFrame([(x,) for x in [*given, None, float("nan")]], "x double")
    got = [r.t for r in df.select(sinks.number_text(F.col("x")).alias("t")).collect()]
    assert got == [*given.values(), None, None]


def test_bitmaps_are_made_without_a_shuffle(spark):
    df = spark.range(0, 100_000, 1, 2).selectExpr(
        "concat('f', id % 3) AS source_file", "IF(id % 5 = 0, NULL, concat('a', id % 700)) AS ad_name",
        "CAST(NULL AS STRING) AS campaign", "IF(id < 70000, 'x', 'y') AS ad_delivery")
    index = op.bitmap_index(df)
    assert "Exchange" not in plan(index)
    # the built-in aggregates give the same bitmaps
    each = df.withColumn("_row", F.monotonically_increasing_id()).selectExpr("_row", "inline(array(" + ", ".join(
        ["struct('*' AS column, CAST(NULL AS STRING) AS value)"] + [f"struct('{c}' AS column, {c} AS value)" for c in facets.COLUMNS]) + "))").where(
        "value IS NOT NULL OR column = '*'")
    want = each.groupBy("column", "value", F.bitmap_bucket_number("_row").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_row")).alias("bits"))
    assert index.count() == want.count() > 2000
    assert index.exceptAll(want).isEmpty() and want.exceptAll(index).isEmpty()


def test_bitmaps_are_dealt_by_their_size_in_memory(spark, monkeypatch):
    monkeypatch.setattr(facets, "BITMAPS_A_TASK", 2)
    index = op.bitmap_index(spark.range(0, 10, 1, 1).selectExpr(
        "'f' AS source_file", "concat('a', id) AS ad_name", "'c' AS campaign", "'x' AS ad_delivery"))
    assert facets._dealt(index)(index).rdd.getNumPartitions() == 9  # 18 bitmaps
    assert tuple(op.kept_count(index, {"ad_name": ["a1", "a2"]}).first()) == (2, 10)


def test_rollup_cells_are_dealt_by_their_number(spark, workdir, monkeypatch):
    ads = ad_report(spark, tables(spark, f"{workdir}/t"))
    monkeypatch.setattr(rollup, "ROWS_A_TASK", 50)
    assert rollup._dealt(ads, ["ad_name"]).rdd.getNumPartitions() == 4
    huge = ads.withColumn("spend", F.when(F.col("spend") > 190, F.lit(float(2 ** 70))).otherwise(F.col("spend")))
    assert op.build_rollup(huge).report("kpis", date_range=None).collect() == op.kpis(huge).collect()
    plain = op.build_rollup(ads)
    assert plain.report("breakdown", "ad_name", date_range=None).collect() == op.breakdown(ads, "ad_name").collect()


def shuffles(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return set(re.findall(r"shuffle_[0-9]+", files.mkString(" ")))


def test_shuffle_files_of_staging_go_once_the_table_is_there(spark, workdir):
    folder = tables(spark, workdir)
    before = shuffles(spark)
    staged = adapter.ad_report(spark, folder)
    until = time.time() + 10
    while shuffles(spark) - before and time.time() < until:  # they are deleted in the background
        time.sleep(0.2)
    assert not shuffles(spark) - before and staged.count() == 200
