"""The registered report queries over the test tables, each with its SQL
twin for the DuckDB oracle.

Every query reads the canonical ad table derived from ``lineitem``,
``orders`` and ``part`` (``adlens.sources.adapter``), so its work grows with
those tables. Columns are aliased identically on both sides. Doubles whose
value depends on summation order (means, correlation, interpolated
quantiles) are rounded to 6 decimals on both sides; money sums are exact
(decimal) and need no rounding.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens import operators as op
from adlens.functions import fill_ranking, na_to_null, to_date_strict, to_number
from adlens.functions.coerce import DATE_PATTERN, MAX_DATE, MIN_DATE, NUMBER_PATTERN
from adlens.schema import AD_COLUMNS, AD_SCHEMA, DISPLAY, MEASURES, NA_TOKENS, REQUIRED_COLUMNS, SNAKE
from adlens.session import is_complete, shared_dir, staged_table
from adlens.sources.adapter import _snapshot_key, ad_report
from adlens.sources.catalog import export_files
from adlens.sources.exports import read_exports, union_frames
from adlens.sources.sinks import (BREAKDOWN_CSV, CORRELATION_CSV, DAILY_CSV, RANKING_CSV, load_ads, save_ads,
                                  with_display_headers, write_correlation_report, write_csv, write_exports, write_report)
from adlens.sources.workbooks import write_workbooks
from adlens.streaming import stream_daily, streamed_daily

# --- Fixed parameters of the registered queries (values of the test tables) --
DATE_RANGE = ("1996-01-01", "1996-12-31")
SOURCES = ("export_1.csv", "export_2.csv")
ADS = ("Brand#11", "Brand#23", "Brand#35", "Brand#52")
CAMPAIGNS = ("PROMO", "STANDARD")
ALL_FILTER = dict(date_range=("1995-06-01", "1999-12-31"),
                  source_files=("export_0.csv", "export_1.csv", "export_2.csv"),
                  ads=("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22", "Brand#31",
                       "Brand#33", "Brand#41", "Brand#44", "Brand#45", "Brand#53", "Brand#55"),
                  campaigns=("ECONOMY", "LARGE", "PROMO", "SMALL"))
FILES_WITHOUT_CAMPAIGN = ("export_1.csv", "export_3.csv")
# text injected by ingest_coerce (number, date and ranking cells)
NUMBER_TOKENS = ("12", " 12 ", "1e3", "+7", ".5", "5.", "inf", "-Infinity", "-", "", "1,234",
                 "1_000", "0x10", "0x1p3", "nan", "NaN", "5%", "$3", "1d", "1f", "True", "1 2",
                 "１２", "NA", "1e400")
DATE_TOKENS = ("2025-01-01", "2025-1-1", " 2025-01-01", "2025-01-01 ", "2025-01-01 00:00:00",
               "2025-01-01T00:00", "2025/01/01", "20250101", "2025-02-30", "25-01-01", "2025-01",
               "Ongoing", "", "0001-01-01", "9999-12-31")
RANKING_TOKENS = ("-", "Average", "Below average (bottom 35% of ads)", "NA", "null", "N/A")
# --- end of fixed parameters -------------------------------------------------

ROUND = 6


@dataclass
class Report:
    name: str
    build: Callable[[DataFrame], DataFrame]
    sql: str | None
    round_cols: tuple[str, ...] = field(default_factory=tuple)
    from_tables: bool = False  # build takes (spark, sf_dir) instead of the ad table


def _r(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), ROUND) for c in cols}) if cols else df


def _rsql(sql: str, cols) -> str:
    if not cols:
        return sql
    rep = ", ".join(f"round({c}, {ROUND}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS q"


def _q(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


# ---------------------------------------------------------------------------
# SQL building blocks (DuckDB)

ADAPTER_SQL = """
ad_base AS (
  SELECT CAST(o.o_orderdate AS DATE) AS reporting_starts, l.l_orderkey, l.l_linenumber,
         l.l_quantity, l.l_extendedprice, l.l_returnflag, p.p_brand, p.p_type,
         round(l.l_quantity * l.l_discount * 100) AS link_clicks,
         CASE WHEN l.l_returnflag = 'R' THEN CAST(0 AS DOUBLE) ELSE l.l_quantity END AS results
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN part p ON l.l_partkey = p.p_partkey),
ad_report AS (
  SELECT reporting_starts,
         reporting_starts + (l_linenumber - 1) AS reporting_ends,
         p_brand AS ad_name,
         CASE l_returnflag WHEN 'A' THEN 'active' WHEN 'R' THEN 'inactive'
              ELSE 'not_delivering' END AS ad_delivery,
         '7-day click or 1-day view' AS attribution_setting,
         results,
         'actions:link_click' AS result_indicator,
         l_quantity * 100 AS reach,
         (l_quantity * 1000) / (l_quantity * 100) AS frequency,
         CASE WHEN results = 0 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice / results END AS cost_per_result,
         'Using campaign budget' AS ad_set_budget,
         '0' AS ad_set_budget_type,
         l_extendedprice AS spend,
         CAST(NULL AS DATE) AS ends,
         '-' AS quality_ranking, '-' AS engagement_ranking, '-' AS conversion_ranking,
         l_quantity * 1000 AS impressions,
         l_extendedprice / (l_quantity * 1000) * 1000 AS cpm,
         link_clicks,
         CAST(0 AS DOUBLE) AS shop_clicks,
         CASE WHEN link_clicks = 0 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice / link_clicks END AS cpc_link,
         link_clicks / (l_quantity * 1000) * 100 AS ctr_link,
         link_clicks + l_linenumber AS clicks_all,
         (link_clicks + l_linenumber) / (l_quantity * 1000) * 100 AS ctr_all,
         l_extendedprice / (link_clicks + l_linenumber) AS cpc_all,
         'export_' || CAST(l_orderkey % 4 AS VARCHAR) || '.csv' AS source_file,
         p_type AS campaign
  FROM ad_base)"""

MONEY_SQL = "CAST(SUM(CAST({c} AS DECIMAL(24,6))) AS DOUBLE)"


def _with(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((ADAPTER_SQL,) + ctes) + "\n" + body


def _inf_ratio(num: str, den: str, scale: str = "") -> str:
    return (f"CASE WHEN {den} <> 0 THEN {num} / {den}{scale} WHEN {num} = 0 THEN CAST(0 AS DOUBLE) "
            f"WHEN {num} > 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST('-Infinity' AS DOUBLE) END")


def _zero_ratio(num: str, den: str, scale: str = "") -> str:
    return f"CASE WHEN {den} > 0 THEN {num} / {den}{scale} ELSE CAST(0 AS DOUBLE) END"


TOTALS_SQL = f"""totals AS (
  SELECT COALESCE({MONEY_SQL.format(c='spend')}, 0) AS total_spend,
         COALESCE(SUM(impressions), 0) AS total_impressions,
         COALESCE(SUM(reach), 0) AS total_reach,
         COALESCE(SUM(link_clicks), 0) AS total_link_clicks,
         COALESCE(SUM(clicks_all), 0) AS total_clicks_all,
         COALESCE(SUM(results), 0) AS total_results
  FROM ad_report)"""

KPI_RATIOS_SQL = (
    f"{_zero_ratio('total_link_clicks', 'total_impressions', ' * 100')} AS overall_ctr, "
    f"{_zero_ratio('total_spend', 'total_link_clicks')} AS overall_cpc, "
    f"{_zero_ratio('total_spend', 'total_impressions', ' * 1000')} AS overall_cpm, "
    f"{_zero_ratio('total_spend', 'total_results')} AS overall_cpr")


def _daily_sql(axis: str) -> str:
    return f"""daily AS (
  SELECT {axis} AS day, {MONEY_SQL.format(c='spend')} AS spend, SUM(link_clicks) AS link_clicks,
         SUM(impressions) AS impressions, SUM(results) AS results
  FROM ad_report WHERE {axis} IS NOT NULL GROUP BY {axis}),
cal AS (SELECT CAST(unnest(generate_series(MIN(day), MAX(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily),
dense AS (
  SELECT cal.day, COALESCE(spend, 0) AS spend, COALESCE(link_clicks, 0) AS link_clicks,
         COALESCE(impressions, 0) AS impressions, COALESCE(results, 0) AS results
  FROM cal LEFT JOIN daily ON cal.day = daily.day)"""


def _cells_sql(axis: str) -> str:
    return f"""cells AS (
  SELECT {axis} AS day, ad_name, {MONEY_SQL.format(c='spend')} AS spend FROM ad_report
  WHERE {axis} IS NOT NULL AND ad_name IS NOT NULL GROUP BY {axis}, ad_name)"""


def _grid_sql(axis: str) -> str:
    return _cells_sql(axis) + """,
grid AS (
  SELECT d.day, a.ad_name, COALESCE(c.spend, 0) AS spend
  FROM (SELECT DISTINCT day FROM cells) d CROSS JOIN (SELECT DISTINCT ad_name FROM cells) a
  LEFT JOIN cells c ON c.day = d.day AND c.ad_name = a.ad_name)"""


def _fmt(spec: str, x: str) -> str:
    return f"format('{{:{spec}}}', {x})"


def _in_list(col: str, xs) -> str:
    return f"{col} IN ({_q(xs)})"


def _date_pred(a: str, b: str) -> str:
    return f"reporting_starts >= DATE '{a}' AND reporting_ends <= DATE '{b}'"


def _box_sql(dim: str, metric: str) -> str:
    return f"""base AS (SELECT {dim} AS g, {metric} AS x FROM ad_report
  WHERE {dim} IS NOT NULL AND {metric} IS NOT NULL AND NOT isnan({metric})),
q AS (SELECT g, COUNT(*) AS n, MIN(x) AS mn, MAX(x) AS mx, quantile_cont(x, 0.25) AS q1,
             quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM base GROUP BY g),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence
      FROM q)"""


_PREVIEW_KEYS = ("source_file", "reporting_starts", "reporting_ends", "ad_name")
PREVIEW_SQL = "SELECT * FROM ad_report ORDER BY " + ", ".join(
    f"{c} ASC NULLS LAST" for c in (*_PREVIEW_KEYS, *(c for c in AD_COLUMNS if c not in _PREVIEW_KEYS))) + " LIMIT {n}"


def _half_sql(p: float) -> str:
    """Interpolated value at position n * p + 1/2 (1-based) of the sorted list ``xs``."""
    pos = f"least(greatest(n * {p} - 0.5, 0), n - 1)"
    lo, hi = (f"xs[CAST({f}({pos}) AS BIGINT) + 1]" for f in ("floor", "ceil"))
    return f"{lo} + ({hi} - {lo}) * ({pos} - floor({pos}))"


_BANDS_SQL = """SELECT day AS reporting_starts, ad_name, spend,
  CAST(SUM(CAST(spend AS DECIMAL(24,6))) OVER w - CAST(spend AS DECIMAL(24,6)) AS DOUBLE) AS y0,
  CAST(SUM(CAST(spend AS DECIMAL(24,6))) OVER w AS DOUBLE) AS y1
FROM {source} WINDOW w AS (PARTITION BY day ORDER BY ad_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

# ---------------------------------------------------------------------------
# amounts beyond the exact range, and value tables as filters

HUGE = "147573952589676412928"  # 2**67: multiples of it are exact in a double


def _money_extremes(d: DataFrame) -> DataFrame:
    """Spend and results per ad when one ad's spend is infinite and another's huge."""
    spend = (F.when(F.col("ad_name") == ADS[0], F.lit(float("inf"))).when(F.col("ad_name") == ADS[1], F.lit(float(HUGE)))
             .otherwise(F.col("spend")))
    return op.breakdown(d.withColumn("spend", spend), "ad_name").select("ad_name", "spend", "results")


def _some_ads(d: DataFrame) -> DataFrame:
    return (d.where("ad_delivery = 'inactive'").groupBy("ad_name").agg(F.max("link_clicks").alias("m"))
            .where("m >= 5 AND ad_name < 'Brand#3'").select("ad_name"))


def _filter_long_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long value table of which few values occur: promotions, and a name for every part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    values = part.select(F.when(F.col("p_type").startswith("PROMO"), F.col("p_type")).alias("v")).unionByName(
        part.select(F.concat_ws("#", "p_type", F.col("p_partkey").cast("string")).alias("v")))
    return op.filter_ads(ad_report(spark, sf_dir), date_range=None, campaigns=values, long_lists=True)


# ---------------------------------------------------------------------------
# ingest_coerce: export text cells derived from lineitem, then the typing rules


def _pick_spark(key, tokens, fallback):
    idx = key % F.lit(97)
    arr = F.array(*[F.lit(t) for t in tokens])
    return F.when(idx < len(tokens), F.element_at(arr, (idx + 1).cast("int"))).otherwise(fallback)


def _ingest_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag")
    k1 = F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7
    k2 = F.col("l_orderkey") * 17 + F.col("l_linenumber") * 3
    k3 = F.col("l_orderkey") * 13 + F.col("l_linenumber") * 11
    raw = li.select(
        "l_orderkey", "l_linenumber",
        _pick_spark(k1, NUMBER_TOKENS, F.col("l_quantity").cast("string")).alias("results_text"),
        _pick_spark(k2, NUMBER_TOKENS, F.col("l_extendedprice").cast("string")).alias("spend_text"),
        _pick_spark(k3, DATE_TOKENS, F.col("l_shipdate").cast("date").cast("string")).alias("date_text"),
        _pick_spark(k1, RANKING_TOKENS, F.lit(None).cast("string")).alias("ranking_text"),
    )
    return raw.select(
        "l_orderkey", "l_linenumber",
        to_number(na_to_null("results_text")).alias("results"),
        to_number(na_to_null("spend_text")).alias("spend"),
        to_date_strict(na_to_null("date_text")).alias("reporting_starts"),
        fill_ranking(na_to_null("ranking_text")).alias("quality_ranking"),
    )


def _pick_sql(key: str, tokens, fallback: str) -> str:
    return (f"CASE WHEN ({key}) % 97 < {len(tokens)} THEN [{_q(tokens)}][CAST(({key}) % 97 AS INTEGER) + 1] "
            f"ELSE {fallback} END")


def _na_sql(x: str) -> str:
    return f"CASE WHEN {x} IN ({_q(NA_TOKENS)}) THEN NULL ELSE {x} END"


def _number_sql(x: str) -> str:
    t = f"TRY_CAST(trim({x}) AS DOUBLE)"
    return (f"CASE WHEN {x} IS NOT NULL AND regexp_full_match({x}, '{NUMBER_PATTERN}') AND "
            f"(regexp_full_match(lower(trim({x})), '[+-]?inf(inity)?') OR isfinite({t})) "
            f"AND {t} IS NOT NULL THEN {t} ELSE CAST(0 AS DOUBLE) END")


def _date_sql(x: str) -> str:
    d = f"CAST(try_strptime({x}, '%Y-%m-%d') AS DATE)"
    return (f"CASE WHEN regexp_full_match({x}, '{DATE_PATTERN}') AND {d} BETWEEN DATE '{MIN_DATE}' "
            f"AND DATE '{MAX_DATE}' THEN {d} END")


INGEST_COERCE_SQL = f"""
WITH raw AS (
  SELECT l_orderkey, l_linenumber,
    {_na_sql(_pick_sql('l_orderkey * 31 + l_linenumber * 7', NUMBER_TOKENS, 'CAST(l_quantity AS VARCHAR)'))} AS rt,
    {_na_sql(_pick_sql('l_orderkey * 17 + l_linenumber * 3', NUMBER_TOKENS, 'CAST(l_extendedprice AS VARCHAR)'))} AS st,
    {_na_sql(_pick_sql('l_orderkey * 13 + l_linenumber * 11', DATE_TOKENS, 'CAST(CAST(l_shipdate AS DATE) AS VARCHAR)'))} AS dt,
    {_na_sql(_pick_sql('l_orderkey * 31 + l_linenumber * 7', RANKING_TOKENS, 'NULL'))} AS kt
  FROM lineitem)
SELECT l_orderkey, l_linenumber, {_number_sql('rt')} AS results, {_number_sql('st')} AS spend,
       {_date_sql('dt')} AS reporting_starts, COALESCE(kt, 'N/A') AS quality_ranking
FROM raw"""


# ---------------------------------------------------------------------------
# union_exports: per-file frames (some without a campaign column) united by name


def _union_exports(ads: DataFrame) -> DataFrame:
    """Exports without a campaign column united by name with those that have one."""
    without = F.col("source_file").isin(*FILES_WITHOUT_CAMPAIGN)
    named, bare = ads.where(~without | F.col("source_file").isNull()), ads.where(without).drop("campaign")
    return union_frames([named, bare]).select(*AD_COLUMNS)


# ---------------------------------------------------------------------------
# ingest_roundtrip: the ad table written by Spark as CSV exports (display
# headers, many files) and read back through the export reader


def _ingest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    csv_dir = f"{shared_dir(spark)}/adlens_exports_{_snapshot_key(spark, sf_dir)}/csv"
    if not is_complete(spark, csv_dir):
        write_csv(ad_report(spark, sf_dir).drop("source_file"), csv_dir)
    # file names of Spark's part files are not stable; everything else is
    return read_exports(spark, [csv_dir]).table.drop("source_file")


# ---------------------------------------------------------------------------
# ingest_exports: the ad table as one export file per source, in two header
# layouts (the second reversed, with an extra `_id` and an extra that has the
# canonical name of another column), beside a file that lacks a required column and a foreign file

MISSING_FILE, MISSING_HEADER, FOREIGN_FILE = "bad.csv", "Amount spent (USD)", "notes.txt"


def _export_folder(spark: SparkSession, sf_dir: str) -> str:
    folder = f"{shared_dir(spark)}/adlens_sources_v2_{_snapshot_key(spark, sf_dir)}"
    if not is_complete(spark, f"{folder}/done"):
        ads = ad_report(spark, sf_dir)
        for r in ads.select("source_file").distinct().collect():
            own = ads.where(F.col("source_file") == r.source_file).drop("source_file")
            if r.source_file in FILES_WITHOUT_CAMPAIGN:
                own = own.withColumn("_id", F.concat("ad_name", F.lit("#"), "ad_delivery")).drop("campaign")
                own = with_display_headers(own.select(*reversed(own.columns))).withColumn("spend", F.lit("twin"))
            else:
                own = with_display_headers(own)
            write_exports(own, f"{folder}/in", r.source_file, display_headers=False)
        write_exports(ads.where(F.col("ad_name") == ADS[0]).drop("spend", "source_file"), f"{folder}/in", MISSING_FILE)
        write_report(ads.groupBy("ad_name").count(), f"{folder}/in", FOREIGN_FILE)
        ads.select("source_file").distinct().write.parquet(f"{folder}/done")
    return f"{folder}/in"


def _source() -> Column:
    """export_1-7.csv, the file of a task, is a part of the export export_1.csv."""
    return F.regexp_replace("source_file", "-[0-9]+[.]csv$", ".csv")


def _ingest_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_exports(spark, [_export_folder(spark, sf_dir)]).table.withColumn("source_file", _source())
    return table.select(*AD_COLUMNS, F.col("_id").alias("id_extra"), F.col("`spend.1`").alias("twin"))


def _ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = read_exports(spark, [_export_folder(spark, sf_dir)])
    rows = load.table.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))
    files = load.report.join(rows, "source_file", "left").withColumn("source_file", _source())
    return files.groupBy("source_file", "status", F.array_join("missing_columns", ",").alias("missing")).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


BREAKS_SQL = "ad_name || chr(10) || '\"' || ad_delivery || '\",' || chr(13) || chr(10) || campaign"


def _ingest_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports whose ad names hold line breaks, commas and quotes, cut into records in parallel."""
    folder = f"{shared_dir(spark)}/adlens_quoted_{_snapshot_key(spark, sf_dir)}"
    if not is_complete(spark, f"{folder}/done"):
        ads = ad_report(spark, sf_dir)
        names = F.concat_ws("", "ad_name", F.lit('\n"'), "ad_delivery", F.lit('",\r\n'), "campaign")
        write_exports(ads.withColumn("ad_name", names).drop("source_file"), f"{folder}/in", "export.csv")
        ads.select("ad_delivery").distinct().write.parquet(f"{folder}/done")
    table = read_exports(spark, [f"{folder}/in"], split_bytes=1 << 16).table
    return table.select("reporting_starts", "reporting_ends", "ad_name", "ad_delivery", "spend", "results", "campaign")


def _ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of the export folder (data source ``ad_files``): status and header width by export."""
    files = export_files(spark, [_export_folder(spark, sf_dir)]).withColumn("source_file", _source())
    return files.select("source_file", "kind", "status", F.array_join("missing_columns", ",").alias("missing"),
                        F.coalesce(F.array_size("header"), F.lit(0)).alias("header_columns")).distinct()


def _stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 from the contributions that a stream over the export folder keeps."""
    table = f"{shared_dir(spark)}/adlens_stream_{uuid.uuid4().hex}"
    stream_daily(spark, _export_folder(spark, sf_dir), table).awaitTermination()
    return streamed_daily(spark, table)


def _ingest_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of which none can be loaded: the lines that each kind offered, and the rows that came of them."""
    folder = _export_folder(spark, sf_dir)
    load = read_exports(spark, [f"{folder}/{MISSING_FILE.removesuffix('.csv')}-*.csv", f"{folder}/{FOREIGN_FILE}"])
    offered = spark.read.text(folder).select(F.col("_metadata.file_name").alias("source_file"))
    lines = load.report.join(offered, "source_file").groupBy("status").agg(
        (F.count(F.lit(1)) - F.count_distinct("source_file")).alias("lines"))
    return lines.withColumn("rows", load.table.agg(F.count(F.lit(1))).scalar())


# ---------------------------------------------------------------------------
# ingest_workbooks: daily spend per ad as workbooks written in tasks (formatted
# blank cells right of the data), read back through the export reader


def _ingest_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = op.spend_by_ad(ad_report(spark, sf_dir))
    given = {"reporting_starts": F.col("reporting_starts").cast("string"), "reporting_ends": F.lit("Ongoing"),
             "ad_name": F.col("ad_name"), "spend": F.col("spend"), "quality_ranking": F.lit("-")}
    rows = cells.select(*[given.get(SNAKE[h], F.lit(None).cast("string")).alias(h) for h in REQUIRED_COLUMNS],
                        F.concat("ad_name", F.lit("/"), F.month("reporting_starts").cast("string")).alias("Campaign name"))
    folder = f"{shared_dir(spark)}/adlens_workbooks_{uuid.uuid4().hex}"
    written = write_workbooks(rows, folder, styled_blanks=3)
    load = read_exports(spark, [r.path for r in written.select("path").collect()])
    return load.table.select("reporting_starts", "reporting_ends", "ad_name", "spend", "results", "quality_ranking", "campaign")


# ---------------------------------------------------------------------------
# sinks: what the CSV downloads and the stored table hold


def _written(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    path = write_report(df, f"{shared_dir(spark)}/adlens_reports_{uuid.uuid4().hex}", name)
    return spark.read.text(path).select(F.col("value").alias("line"))


def _lines_sql(header: str, columns: tuple[str, ...], source: str) -> str:
    cells = ", ".join(f"COALESCE(CAST({c} AS VARCHAR), '')" for c in columns)
    return f"SELECT '{header}' AS line UNION ALL SELECT concat_ws(',', {cells}) AS line FROM ({source}) AS t"


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/adlens_saved_{uuid.uuid4().hex}"
    return load_ads(spark, save_ads(ad_report(spark, sf_dir), path))


# ---------------------------------------------------------------------------
# correlation SQL (generated for the 14 measures)


def _corr_cell(a: str, b: str) -> str:
    return f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END"


def _correlation_sql() -> str:
    cells = ",\n  ".join(f"{_corr_cell(a, b)} AS \"{a}__{b}\"" for a in MEASURES for b in MEASURES)
    rows = "\nUNION ALL ".join(
        f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, \"{a}__{b}\" AS r FROM c"
        for a in MEASURES for b in MEASURES)
    return _with(rows, f"c AS (SELECT\n  {cells}\nFROM ad_report)")


def _correlation_wide_sql() -> str:
    cols = ", ".join(f"MAX(r) FILTER (WHERE metric_b = '{b}') AS {b}" for b in MEASURES)
    return f"SELECT metric_a AS metric, {cols} FROM ({_correlation_sql()}) AS l GROUP BY metric_a"


# ---------------------------------------------------------------------------
# stored aggregates: the same answers without the fact table

_STORED: dict[tuple, object] = {}


def _stored(kind: str, make: Callable[[DataFrame], object], spark: SparkSession, sf_dir: str):
    """``make`` of the ad table, once a session and snapshot."""
    key = (spark.sparkContext.applicationId, kind, shared_dir(spark), _snapshot_key(spark, sf_dir))
    if key not in _STORED:
        _STORED[key] = make(ad_report(spark, sf_dir))
    return _STORED[key]


def _rollup(spark: SparkSession, sf_dir: str) -> op.Rollup:
    return _stored("rollup", op.build_rollup, spark, sf_dir)


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored("bitmaps", lambda ads: staged_table(op.bitmap_index(ads), "bitmap_index"), spark, sf_dir)


def _box_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles from stored sketches under a date filter, and whether their exact ranks keep the stated error.

    The error holds for one answer with 99 %; three times it is allowed for all of them together."""
    cells = _stored("sketches", lambda ads: staged_table(op.quantile_cells(ads), "quantile_cells"), spark, sf_dir)
    answers = staged_table(op.sketched_quartiles(cells, date_range=DATE_RANGE), "quartiles")
    gaps = op.rank_gaps(op.filter_ads(ad_report(spark, sf_dir), date_range=DATE_RANGE), answers)
    return gaps.select("ad_delivery", "n", *[(F.col(f"gap_{q}") <= 3 * op.rank_error()).alias(f"{q}_within") for q in ("q1", "median", "q3")])


FACETS = {"source_file": SOURCES, "ad_name": ADS, "ad_delivery": ("active", "inactive")}


def _facet_sql() -> str:
    conditions = {c: _in_list(c, v) for c, v in FACETS.items()}
    parts = []
    for c in ("source_file", "ad_name", "campaign", "ad_delivery"):
        others = " AND ".join(x for k, x in conditions.items() if k != c)
        parts.append(f"SELECT '{c}' AS \"column\", {c} AS value, COUNT(*) AS rows FROM ad_report WHERE {others} AND {c} IS NOT NULL GROUP BY {c}")
    return _with("\nUNION ALL ".join(parts))


def _correlation_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the correlation download, r to ten digits."""
    matrix = op.correlation_matrix(ad_report(spark, sf_dir))
    matrix = matrix.select("metric", *[F.round(c, 10).alias(c) for c in MEASURES])
    path = write_correlation_report(matrix, f"{shared_dir(spark)}/adlens_reports_{uuid.uuid4().hex}", CORRELATION_CSV)
    return spark.read.text(path).select(F.col("value").alias("line"))


def _correlation_file_sql() -> str:
    names = {m: f'"{DISPLAY[m]}"' if "," in DISPLAY[m] else DISPLAY[m] for m in MEASURES}  # as CSV quotes them
    header = "," + ",".join(names.values())
    label = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{n}'" for m, n in names.items()) + " END"
    cells = ", ".join(f"COALESCE(CAST(round({m}, 10) AS VARCHAR), '')" for m in MEASURES)
    return f"SELECT '{header}' AS line UNION ALL SELECT concat_ws(',', {label}, {cells}) FROM ({_correlation_wide_sql()}) AS m"


def _columns_sql() -> str:
    one = [f"SELECT CAST({i} AS INTEGER) AS position, '{f.name}' AS name, '{DISPLAY.get(f.name, f.name) if f.name != 'campaign' else f.name}'"
           f" AS display_name, '{f.dataType.simpleString()}' AS data_type, COUNT({f.name}) AS filled FROM ad_report"
           for i, f in enumerate(AD_SCHEMA.fields, 1)]
    return _with("\nUNION ALL ".join(one))


# ---------------------------------------------------------------------------

def _breakdown_sql(dim: str) -> str:
    return _with(_breakdown_body(dim))


def _breakdown_body(dim: str) -> str:
    return f"""SELECT {dim}, spend, link_clicks, impressions, results,
  {_inf_ratio('link_clicks', 'impressions', ' * 100')} AS ctr_link,
  {_inf_ratio('spend', 'results')} AS cost_per_result
FROM (SELECT {dim}, {MONEY_SQL.format(c='spend')} AS spend, SUM(link_clicks) AS link_clicks,
             SUM(impressions) AS impressions, SUM(results) AS results
      FROM ad_report WHERE {dim} IS NOT NULL GROUP BY {dim}) AS b"""


def _filter_sql(where: str) -> str:
    return _with(f"SELECT * FROM ad_report WHERE {where}")


ALL_FILTER_SQL = " AND ".join([
    _date_pred(*ALL_FILTER["date_range"]), _in_list("source_file", ALL_FILTER["source_files"]),
    _in_list("ad_name", ALL_FILTER["ads"]), _in_list("campaign", ALL_FILTER["campaigns"])])

HEAT_DAYS = range(1, 32)

REPORTS: list[Report] = [
    Report("kpis", op.kpis, _with(f"SELECT *, {KPI_RATIOS_SQL} FROM totals", TOTALS_SQL)),
    Report("kpi_cards", op.kpi_cards, _with(f"""SELECT '$' || {_fmt(',.2f', 'total_spend')} AS total_spend,
  {_fmt(',.0f', 'total_impressions')} AS total_impressions, {_fmt(',.0f', 'total_reach')} AS total_reach,
  {_fmt(',.0f', 'total_link_clicks')} AS total_link_clicks, {_fmt('.2f', 'overall_ctr')} || '%' AS overall_ctr,
  '$' || {_fmt('.2f', 'overall_cpc')} AS overall_cpc, '$' || {_fmt('.2f', 'overall_cpm')} AS overall_cpm,
  {_fmt(',.0f', 'total_clicks_all')} AS total_clicks_all, {_fmt(',.0f', 'total_results')} AS total_results,
  '$' || {_fmt('.2f', 'overall_cpr')} AS cost_per_result
FROM (SELECT *, {KPI_RATIOS_SQL} FROM totals) AS k""", TOTALS_SQL)),
    Report("funnel", op.funnel, _with("""
SELECT CAST(1 AS INTEGER) AS step, 'Impressions' AS stage, total_impressions AS value,
       CASE WHEN total_impressions > 0 THEN total_impressions / total_impressions * 100 END AS pct_initial FROM totals
UNION ALL
SELECT CAST(2 AS INTEGER), 'Link Clicks', total_link_clicks,
       CASE WHEN total_impressions > 0 THEN total_link_clicks / total_impressions * 100 END FROM totals
UNION ALL
SELECT CAST(3 AS INTEGER), 'Results', total_results,
       CASE WHEN total_impressions > 0 THEN total_results / total_impressions * 100 END FROM totals""",
                                      TOTALS_SQL)),
    Report("date_bounds", op.date_bounds,
           _with("SELECT MIN(reporting_starts) AS min_date, MAX(reporting_ends) AS max_date FROM ad_report")),
    Report("filter_date_range", lambda d: op.filter_ads(d, date_range=DATE_RANGE),
           _filter_sql(_date_pred(*DATE_RANGE))),
    Report("filter_source", lambda d: op.filter_ads(d, date_range=None, source_files=SOURCES),
           _filter_sql(_in_list("source_file", SOURCES))),
    Report("filter_ads_in", lambda d: op.filter_ads(d, date_range=None, ads=ADS),
           _filter_sql(_in_list("ad_name", ADS))),
    Report("filter_campaign", lambda d: op.filter_ads(d, date_range=None, campaigns=CAMPAIGNS),
           _filter_sql(_in_list("campaign", CAMPAIGNS))),
    Report("filter_all", lambda d: op.filter_ads(d, **ALL_FILTER), _filter_sql(ALL_FILTER_SQL)),
    Report("filter_summary", lambda d: op.filter_summary(d, **ALL_FILTER),
           _with(f"SELECT COUNT(*) FILTER (WHERE {ALL_FILTER_SQL}) AS kept_rows, COUNT(*) AS total_rows "
                 "FROM ad_report")),
    Report("options_ad_name", lambda d: op.options(d, "ad_name"),
           _with("SELECT DISTINCT ad_name FROM ad_report WHERE ad_name IS NOT NULL")),
    Report("preview", lambda d: op.preview(d, 20),
           _with(PREVIEW_SQL.format(n=20))),
    Report("source_summary", op.source_summary,
           _with("SELECT source_file, COUNT(*) AS rows FROM ad_report GROUP BY source_file")),
    Report("union_exports", _union_exports,
           _with("SELECT * REPLACE (CASE WHEN source_file IN (" + _q(FILES_WITHOUT_CAMPAIGN)
                 + ") THEN NULL ELSE campaign END AS campaign) FROM ad_report")),
    Report("daily_series", lambda d: op.daily_series(d, "reporting_starts"),
           _with("SELECT day AS reporting_starts, spend, link_clicks, impressions, results FROM dense",
                 _daily_sql("reporting_starts"))),
    Report("daily_series_ends", lambda d: op.daily_series(d, "reporting_ends"),
           _with("SELECT day AS reporting_ends, spend, link_clicks, impressions, results FROM dense",
                 _daily_sql("reporting_ends"))),
    Report("daily_long", lambda d: op.daily_long(d, ("spend", "link_clicks")),
           _with("SELECT day AS reporting_starts, 'spend' AS metric, spend AS value FROM dense UNION ALL "
                 "SELECT day, 'link_clicks', link_clicks FROM dense", _daily_sql("reporting_starts"))),
    Report("heatmap_long", op.heatmap_long,
           _with("SELECT CAST(month(day) AS INTEGER) AS month, CAST(day(day) AS INTEGER) AS day, "
                 "AVG(spend) AS spend FROM dense GROUP BY 1, 2", _daily_sql("reporting_starts")),
           ("spend",)),
    Report("heatmap_wide", op.heatmap_wide,
           _with("SELECT CAST(month(day) AS INTEGER) AS month, " + ", ".join(
               f"COALESCE(AVG(spend) FILTER (WHERE day(day) = {i}), 0) AS d{i}" for i in HEAT_DAYS)
               + " FROM dense GROUP BY 1", _daily_sql("reporting_starts")),
           tuple(f"d{i}" for i in HEAT_DAYS)),
    Report("breakdown_ad", lambda d: op.breakdown(d, "ad_name"), _breakdown_sql("ad_name")),
    Report("breakdown_delivery", lambda d: op.breakdown(d, "ad_delivery"), _breakdown_sql("ad_delivery")),
    Report("scatter", op.scatter,
           _with(f"SELECT ad_name, AVG(cpc_link) AS cpc_link, AVG(ctr_link) AS ctr_link, "
                 f"{MONEY_SQL.format(c='spend')} AS spend, SUM(impressions) AS impressions "
                 "FROM ad_report WHERE ad_name IS NOT NULL GROUP BY ad_name"),
           ("cpc_link", "ctr_link")),
    Report("spend_by_ad", lambda d: op.spend_by_ad(d, "reporting_starts"),
           _with("SELECT day AS reporting_starts, ad_name, spend FROM cells", _cells_sql("reporting_starts"))),
    Report("spend_by_ad_dense", lambda d: op.spend_by_ad_dense(d, "reporting_starts"),
           _with("SELECT day AS reporting_starts, ad_name, spend FROM grid", _grid_sql("reporting_starts"))),
    Report("stacked", lambda d: op.stacked(d, "reporting_starts", dense=True),
           _with("""SELECT day AS reporting_starts, ad_name, spend,
  CAST(SUM(CAST(spend AS DECIMAL(24,6))) OVER w - CAST(spend AS DECIMAL(24,6)) AS DOUBLE) AS y0,
  CAST(SUM(CAST(spend AS DECIMAL(24,6))) OVER w AS DOUBLE) AS y1
FROM grid WINDOW w AS (PARTITION BY day ORDER BY ad_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
                 _grid_sql("reporting_starts"))),
    Report("stacked_sparse", lambda d: op.stacked(d, "reporting_starts"),
           _with(_BANDS_SQL.format(source="cells"), _cells_sql("reporting_starts"))),
    Report("stacked_top5", lambda d: op.stacked(d, "reporting_starts", top_n_ads=5),
           _with(_BANDS_SQL.format(source="(SELECT * FROM cells WHERE ad_name IN (SELECT ad_name FROM cells "
                                          "GROUP BY ad_name ORDER BY SUM(CAST(spend AS DECIMAL(24,6))) DESC, ad_name "
                                          "LIMIT 5)) AS t"), _cells_sql("reporting_starts"))),
    Report("spend_share", lambda d: op.spend_share(d, "ad_delivery"),
           _with(f"""SELECT ad_delivery, CAST(s AS DOUBLE) AS spend,
  CASE WHEN SUM(s) OVER () <> 0 THEN CAST(s AS DOUBLE) / CAST(SUM(s) OVER () AS DOUBLE) ELSE 0 END AS share
FROM (SELECT ad_delivery, SUM(CAST(spend AS DECIMAL(24,6))) AS s FROM ad_report
      WHERE ad_delivery IS NOT NULL GROUP BY ad_delivery) AS g"""), ("share",)),
    Report("box_stats", lambda d: op.box_stats(d, "ad_delivery", "cpc_link"),
           _with("""SELECT f.g AS ad_delivery, n, mn AS min, q1, median, q3, mx AS max, iqr, lower_fence,
  upper_fence, w.lower_whisker, w.upper_whisker, w.n_outliers
FROM f JOIN (SELECT b.g, MIN(x) FILTER (WHERE x >= lower_fence) AS lower_whisker,
                    MAX(x) FILTER (WHERE x <= upper_fence) AS upper_whisker,
                    COUNT(*) FILTER (WHERE x < lower_fence OR x > upper_fence) AS n_outliers
             FROM base b JOIN f ON b.g = f.g GROUP BY b.g) AS w ON f.g = w.g""",
                 _box_sql("ad_delivery", "cpc_link")),
           ("q1", "median", "q3", "iqr", "lower_fence", "upper_fence")),
    Report("box_outliers", lambda d: op.box_outliers(d, "ad_delivery", "cpc_link"),
           _with("SELECT b.g AS ad_delivery, b.x AS cpc_link FROM base b JOIN f ON b.g = f.g "
                 "WHERE b.x < f.lower_fence OR b.x > f.upper_fence", _box_sql("ad_delivery", "cpc_link"))),
    Report("box_stats_half", lambda d: op.quartiles(d, "ad_delivery", "cpc_link", method="np_half"),
           _with(f"""SELECT g AS ad_delivery, n, mn AS min, mx AS max, {_half_sql(0.25)} AS q1, {_half_sql(0.5)} AS median,
  {_half_sql(0.75)} AS q3
FROM (SELECT g, COUNT(*) AS n, MIN(x) AS mn, MAX(x) AS mx, list_sort(list(x)) AS xs FROM base GROUP BY g) AS s""",
                 _box_sql("ad_delivery", "cpc_link").split(",\nq AS")[0]), ("q1", "median", "q3")),
    Report("rank_ads", op.rank_ads,
           _with(f"""SELECT ad_name, cost_per_result, spend, results, impressions,
  ROW_NUMBER() OVER (ORDER BY cost_per_result ASC NULLS LAST, ad_name) AS rank
FROM (SELECT ad_name, AVG(cost_per_result) AS cost_per_result, {MONEY_SQL.format(c='spend')} AS spend,
             SUM(results) AS results, SUM(impressions) AS impressions
      FROM ad_report WHERE ad_name IS NOT NULL GROUP BY ad_name) AS a"""), ("cost_per_result",)),
    Report("correlation", op.correlation, _correlation_sql(), ("r",)),
    Report("correlation_wide", op.correlation_matrix, _correlation_wide_sql(), MEASURES),
    Report("compare_kpis", lambda d: op.compare_kpis(d, "source_file"),
           _with(f"""SELECT *, {KPI_RATIOS_SQL} FROM (
  SELECT source_file AS item, {MONEY_SQL.format(c='spend')} AS total_spend,
         SUM(impressions) AS total_impressions, SUM(reach) AS total_reach,
         SUM(link_clicks) AS total_link_clicks, SUM(clicks_all) AS total_clicks_all,
         SUM(results) AS total_results
  FROM ad_report WHERE source_file IN (SELECT DISTINCT source_file FROM ad_report
                                       WHERE source_file IS NOT NULL ORDER BY 1 LIMIT 2)
  GROUP BY source_file) AS t""")),
    Report("compare_daily", lambda d: op.compare_daily(d, "ad_delivery", ("active", "inactive")),
           _with(f"""SELECT reporting_starts, ad_delivery AS item, {MONEY_SQL.format(c='spend')} AS spend,
  SUM(link_clicks) AS link_clicks, SUM(impressions) AS impressions
FROM ad_report WHERE ad_delivery IN ('active', 'inactive') AND reporting_starts IS NOT NULL
GROUP BY reporting_starts, ad_delivery""")),
    Report("performers", op.performers,
           _with("""SELECT COALESCE((SELECT ad_name FROM a ORDER BY m, ad_name LIMIT 1), 'N/A') AS top_performer,
       COALESCE((SELECT ad_name FROM a ORDER BY m DESC, ad_name DESC LIMIT 1), 'N/A') AS bottom_performer""",
                 "a AS (SELECT ad_name, AVG(cost_per_result) AS m FROM ad_report "
                 "WHERE ad_name IS NOT NULL GROUP BY ad_name)")),
    Report("insight_kpis", op.insight_kpis,
           _with(f"""SELECT '$' || {_fmt(',.2f', 'total_spend')} AS total_spend,
  {_fmt(',.0f', 'total_impressions')} AS total_impressions,
  {_fmt(',.0f', 'total_link_clicks')} AS total_link_clicks,
  CASE WHEN total_link_clicks > 0 THEN '$' || {_fmt('.2f', 'total_spend / total_link_clicks')} ELSE 'N/A' END
    AS overall_cpc,
  CASE WHEN total_impressions > 0 THEN {_fmt('.2f', 'total_link_clicks / total_impressions * 100')} || '%'
    ELSE 'N/A' END AS overall_ctr,
  {_fmt(',.0f', 'total_results')} AS total_results,
  CASE WHEN total_results > 0 THEN '$' || {_fmt('.2f', 'total_spend / total_results')} ELSE 'N/A' END
    AS overall_cost_per_result
FROM totals""", TOTALS_SQL)),
    Report("insight_context", op.insight_context,
           _with(f"""SELECT strftime(p.s, '%Y-%m-%d') AS period_start, strftime(p.e, '%Y-%m-%d') AS period_end,
  k.*, COALESCE((SELECT ad_name FROM a ORDER BY m, ad_name LIMIT 1), 'N/A') AS top_performer,
  COALESCE((SELECT ad_name FROM a ORDER BY m DESC, ad_name DESC LIMIT 1), 'N/A') AS bottom_performer
FROM (SELECT MIN(reporting_starts) AS s, MAX(reporting_ends) AS e FROM ad_report) AS p,
(SELECT '$' || {_fmt(',.2f', 'total_spend')} AS total_spend,
  {_fmt(',.0f', 'total_impressions')} AS total_impressions,
  {_fmt(',.0f', 'total_link_clicks')} AS total_link_clicks,
  CASE WHEN total_link_clicks > 0 THEN '$' || {_fmt('.2f', 'total_spend / total_link_clicks')} ELSE 'N/A' END
    AS overall_cpc,
  CASE WHEN total_impressions > 0 THEN {_fmt('.2f', 'total_link_clicks / total_impressions * 100')} || '%'
    ELSE 'N/A' END AS overall_ctr,
  {_fmt(',.0f', 'total_results')} AS total_results,
  CASE WHEN total_results > 0 THEN '$' || {_fmt('.2f', 'total_spend / total_results')} ELSE 'N/A' END
    AS overall_cost_per_result
 FROM totals) AS k""", TOTALS_SQL,
                 "a AS (SELECT ad_name, AVG(cost_per_result) AS m FROM ad_report "
                 "WHERE ad_name IS NOT NULL GROUP BY ad_name)")),
    Report("insight_preview", op.insight_preview, _with(PREVIEW_SQL.format(n=5))),
    Report("money_extremes", _money_extremes,
           _with(f"""SELECT ad_name, CAST(SUM(spend) AS DOUBLE) AS spend, SUM(results) AS results FROM (
  SELECT ad_name, results, CASE ad_name WHEN '{ADS[0]}' THEN CAST('Infinity' AS DOUBLE) WHEN '{ADS[1]}' THEN {HUGE}
    ELSE 0 END AS spend FROM ad_report) AS x WHERE ad_name IN ('{ADS[0]}', '{ADS[1]}') GROUP BY ad_name
UNION ALL
SELECT ad_name, {MONEY_SQL.format(c='spend')} AS spend, SUM(results) AS results FROM ad_report
WHERE ad_name NOT IN ('{ADS[0]}', '{ADS[1]}') GROUP BY ad_name""")),
    Report("filter_frame", lambda d: op.filter_ads(d, date_range=None, ads=_some_ads(d)),
           _filter_sql("ad_name IN (SELECT ad_name FROM ad_report WHERE ad_delivery = 'inactive' GROUP BY ad_name "
                       "HAVING MAX(link_clicks) >= 5 AND ad_name < 'Brand#3')")),
    Report("filter_long_frame", _filter_long_frame, _filter_sql("campaign LIKE 'PROMO%'"), from_tables=True),
    Report("filter_frame_summary", lambda d: op.filter_summary(d, date_range=None, ads=_some_ads(d), source_files=SOURCES),
           _with("SELECT COUNT(*) FILTER (WHERE ad_name IN (SELECT ad_name FROM ad_report WHERE ad_delivery = 'inactive' "
                 "GROUP BY ad_name HAVING MAX(link_clicks) >= 5 AND ad_name < 'Brand#3') AND " + _in_list("source_file", SOURCES)
                 + ") AS kept_rows, COUNT(*) AS total_rows FROM ad_report")),
    Report("highest_ctr_ad", op.highest_ctr_ad,
           _with("""SELECT ad_name, ctr FROM (
  SELECT ad_name, SUM(link_clicks) / SUM(impressions) * 100 AS ctr FROM ad_report
  WHERE ad_name IS NOT NULL GROUP BY ad_name HAVING SUM(impressions) > 0) AS c
ORDER BY ctr DESC, ad_name LIMIT 1""")),
    Report("average_spend_per_day", op.average_spend_per_day,
           _with("""SELECT COALESCE(CAST(SUM(s) AS DOUBLE), 0) AS total_spend, COUNT(reporting_starts) AS days,
  CASE WHEN COUNT(reporting_starts) > 0 THEN CAST(SUM(s) AS DOUBLE) / COUNT(reporting_starts) END
    AS avg_spend_per_day
FROM (SELECT reporting_starts, SUM(CAST(spend AS DECIMAL(24,6))) AS s FROM ad_report
      GROUP BY reporting_starts) AS d""")),
    Report("ingest_coerce", _ingest_coerce, INGEST_COERCE_SQL, from_tables=True),
    Report("ingest_exports", _ingest_exports,
           _with(f"""SELECT * REPLACE (CASE WHEN {_in_list('source_file', FILES_WITHOUT_CAMPAIGN)} THEN NULL ELSE campaign END
  AS campaign), CASE WHEN {_in_list('source_file', FILES_WITHOUT_CAMPAIGN)} THEN ad_name || '#' || ad_delivery END
  AS id_extra, CASE WHEN {_in_list('source_file', FILES_WITHOUT_CAMPAIGN)} THEN 'twin' END AS twin FROM ad_report"""),
           from_tables=True),
    Report("ingest_quoted", _ingest_quoted,
           _with(f"""SELECT reporting_starts, reporting_ends, {BREAKS_SQL} AS ad_name, ad_delivery, spend, results, campaign
FROM ad_report"""), from_tables=True),
    Report("ingest_files", _ingest_files,
           _with(f"""SELECT DISTINCT source_file, 'csv' AS kind, 'ok' AS status, CAST(NULL AS VARCHAR) AS missing,
  CASE WHEN {_in_list('source_file', FILES_WITHOUT_CAMPAIGN)} THEN 28 ELSE 27 END AS header_columns FROM ad_report
UNION ALL SELECT '{MISSING_FILE}', 'csv', 'missing_columns', '{MISSING_HEADER}', 26
UNION ALL SELECT '{FOREIGN_FILE}', 'other', 'unsupported', NULL, 0"""), from_tables=True),
    Report("stream_daily", _stream_daily,
           _with("SELECT day AS reporting_starts, spend, link_clicks, impressions, results FROM dense",
                 _daily_sql("reporting_starts")), from_tables=True),
    Report("ingest_report", _ingest_report,
           _with(f"""SELECT source_file, 'ok' AS status, CAST(NULL AS VARCHAR) AS missing, COUNT(*) AS rows FROM ad_report
GROUP BY source_file UNION ALL SELECT '{MISSING_FILE}', 'missing_columns', '{MISSING_HEADER}', 0
UNION ALL SELECT '{FOREIGN_FILE}', 'unsupported', NULL, 0"""), from_tables=True),
    Report("ingest_nothing", _ingest_nothing,
           _with(f"""SELECT 'missing_columns' AS status, COUNT(*) AS lines, 0 AS rows FROM ad_report WHERE ad_name = '{ADS[0]}'
UNION ALL SELECT 'unsupported', COUNT(DISTINCT ad_name), 0 FROM ad_report"""), from_tables=True),
    Report("ingest_workbooks", _ingest_workbooks,
           _with("""SELECT day AS reporting_starts, CAST(NULL AS DATE) AS reporting_ends, ad_name, spend,
  CAST(0 AS DOUBLE) AS results, '-' AS quality_ranking, ad_name || '/' || CAST(month(day) AS VARCHAR) AS campaign
FROM cells""", _cells_sql("reporting_starts")), from_tables=True),
    Report("csv_daily", lambda s, d: _written(op.daily_series(ad_report(s, d)), s, DAILY_CSV),
           _with(_lines_sql("Reporting starts,Amount spent (USD),Link clicks,Impressions,Results",
                            ("reporting_starts", "spend", "link_clicks", "impressions", "results"),
                            "SELECT day AS reporting_starts, * EXCLUDE (day) FROM dense"),
                 _daily_sql("reporting_starts")), from_tables=True),
    Report("csv_breakdown", lambda s, d: _written(op.breakdown(ad_report(s, d), "ad_delivery"), s, BREAKDOWN_CSV),
           _with(_lines_sql("Ad delivery,Amount spent (USD),Link clicks,Impressions,Results,CTR (link click-through rate),"
                            "Cost per results",
                            ("ad_delivery", "spend", "link_clicks", "impressions", "results", "ctr_link", "cost_per_result"),
                            _breakdown_body("ad_delivery"))), from_tables=True),
    Report("csv_ranking", lambda s, d: _written(
               op.rank_ads(ad_report(s, d)).select("ad_name", F.round("cost_per_result", ROUND).alias("cost_per_result"),
                                                   "spend", "results", "impressions"), s, RANKING_CSV),
           _with(_lines_sql("Ad name,Cost per results,Amount spent (USD),Results,Impressions",
                            ("ad_name", "cost_per_result", "spend", "results", "impressions"),
                            f"""SELECT ad_name, round(AVG(cost_per_result), {ROUND}) AS cost_per_result,
  {MONEY_SQL.format(c='spend')} AS spend, SUM(results) AS results, SUM(impressions) AS impressions
FROM ad_report GROUP BY ad_name""")), from_tables=True),
    Report("rollup_kpis", lambda s, d: _rollup(s, d).report("kpis", date_range=DATE_RANGE),
           _with(f"SELECT *, {KPI_RATIOS_SQL} FROM totals", TOTALS_SQL.replace("FROM ad_report", f"FROM ad_report WHERE {_date_pred(*DATE_RANGE)}")),
           from_tables=True),
    Report("rollup_breakdown", lambda s, d: _rollup(s, d).report(
               "breakdown", "ad_name", date_range=ALL_FILTER["date_range"], source_files=ALL_FILTER["source_files"]),
           _with(_breakdown_body("ad_name").replace("FROM ad_report WHERE", "FROM ad_report WHERE " + _date_pred(
               *ALL_FILTER["date_range"]) + " AND " + _in_list("source_file", ALL_FILTER["source_files"]) + " AND")), from_tables=True),
    Report("rollup_spend_share", lambda s, d: _rollup(s, d).report("spend_share", "ad_delivery", date_range=None, campaigns=CAMPAIGNS),
           _with(f"""SELECT ad_delivery, CAST(s AS DOUBLE) AS spend,
  CASE WHEN SUM(s) OVER () <> 0 THEN CAST(s AS DOUBLE) / CAST(SUM(s) OVER () AS DOUBLE) ELSE 0 END AS share
FROM (SELECT ad_delivery, SUM(CAST(spend AS DECIMAL(24,6))) AS s FROM ad_report
      WHERE ad_delivery IS NOT NULL AND {_in_list('campaign', CAMPAIGNS)} GROUP BY ad_delivery) AS g"""), ("share",), from_tables=True),
    Report("facet_counts", lambda s, d: op.facet_counts(_index(s, d), FACETS), _facet_sql(), from_tables=True),
    Report("facet_kept", lambda s, d: op.kept_count(_index(s, d), FACETS),
           _with("SELECT COUNT(*) FILTER (WHERE " + " AND ".join(_in_list(c, v) for c, v in FACETS.items())
                 + ") AS kept_rows, COUNT(*) AS total_rows FROM ad_report"), from_tables=True),
    Report("box_sketch", _box_sketch,
           _with(f"""SELECT ad_delivery, COUNT(*) AS n, true AS q1_within, true AS median_within, true AS q3_within FROM ad_report
WHERE {_date_pred(*DATE_RANGE)} AND isfinite(cpc_link) GROUP BY ad_delivery"""), from_tables=True),
    Report("csv_correlation", _correlation_file, _correlation_file_sql(), from_tables=True),
    Report("describe_columns", op.describe_columns, _columns_sql()),
    Report("save_load_ads", _saved, _with("SELECT * FROM ad_report"), from_tables=True),
    Report("ingest_roundtrip", _ingest_roundtrip, _with("SELECT * EXCLUDE (source_file) FROM ad_report"),
           from_tables=True),
]

BY_NAME: dict[str, Report] = {r.name: r for r in REPORTS}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    r = BY_NAME[name]
    df = r.build(spark, sf_dir) if r.from_tables else r.build(ad_report(spark, sf_dir))
    return _r(df, r.round_cols)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {r.name: (lambda spark, sf_dir, _n=r.name: run(_n, spark, sf_dir)) for r in REPORTS}


def oracle_sql() -> dict[str, str]:
    return {r.name: _rsql(r.sql, r.round_cols) for r in REPORTS if r.sql is not None}
