"""Filters, options and previews over the ad table.

All filters compose into one ``where`` conjunction, so Catalyst combines
them and pushes them into the Parquet scan (``PushedFilters``).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.schema import AD_COLUMNS, CAMPAIGN_HEADERS, SNAKE
from adlens.session import staged_table


class _AllDates:
    """Default date range: the table's own bounds (min start .. max end).

    Every non-null start is >= the minimum start and every non-null end is
    <= the maximum end, so the default range keeps exactly the rows whose
    start and end are both known; no bounds job is needed for it.
    """

    def __repr__(self) -> str:
        return "ALL_DATES"


ALL_DATES = _AllDates()

ListArg = Sequence[str] | DataFrame | None


def date_bounds(df: DataFrame) -> DataFrame:
    """one row (min_date, max_date) = (min start, max end); nulls ignored."""
    return df.agg(F.min("reporting_starts").alias("min_date"),
                  F.max("reporting_ends").alias("max_date"))


def _date_lit(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, (_dt.date, _dt.datetime)):
        v = v.strftime("%Y-%m-%d")
    return F.lit(v).cast("date")


def resolve_campaign(columns: Sequence[str]) -> str | None:
    """the campaign column of a table, by priority.

    The canonical table has chosen already (``campaign``; other campaign
    headers are extras there); a table of display headers is searched for
    ``Campaign name`` > ``Ad set name`` > ``Ad set`` > ``Campaign``.
    """
    if "campaign" in columns:
        return "campaign"
    return next((c for c in CAMPAIGN_HEADERS if c in columns), None)


def _in(c: str, values: ListArg) -> Column | None:
    if values is None or isinstance(values, DataFrame):
        return None
    values = list(values)
    return F.col(c).isin(values) if values else None


def date_predicate(date_range=ALL_DATES) -> Column | None:
    """containment of [reporting_starts, reporting_ends] in the range,
    inclusive. ``None`` or a range with one end = no date filter."""
    if date_range is None:
        return None
    if date_range is ALL_DATES:
        return F.col("reporting_starts").isNotNull() & F.col("reporting_ends").isNotNull()
    if len(date_range) != 2 or any(v is None for v in date_range):
        return None
    a, b = date_range
    return (F.col("reporting_starts") >= _date_lit(a)) & (F.col("reporting_ends") <= _date_lit(b))


def filter_predicate(df: DataFrame, date_range=ALL_DATES, source_files: ListArg = None,
                     ads: ListArg = None, campaigns: ListArg = None) -> Column | None:
    """the conjunction date -> source file -> ad -> campaign as one column.

    Empty or missing lists mean "no filter". Nulls never match a list.
    """
    camp = resolve_campaign(df.columns)
    parts = [date_predicate(date_range), _in("source_file", source_files), _in("ad_name", ads)]
    if camp is not None:
        parts.append(_in(camp, campaigns))
    parts = [p for p in parts if p is not None]
    if not parts:
        return None
    pred = parts[0]
    for p in parts[1:]:
        pred = pred & p
    return pred


BLOOM_HASHES = 4
BLOOM_BITS_A_VALUE = 12  # about one false hit in 250
BLOOM_MOST_BITS = 1 << 26  # 8 MB; beyond it the filter only lets more rows through


def bloom_bits(values: int) -> int:
    """The size of a filter for so many values: a power of two within the bounds."""
    return min(BLOOM_MOST_BITS, max(1 << 12, 1 << (values * BLOOM_BITS_A_VALUE - 1).bit_length()))


def _bit_places(c: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(c, F.lit(i)), F.lit(bits)) for i in range(BLOOM_HASHES)]


def may_contain(values: DataFrame, c: Column, count: int) -> Column:
    """A condition that holds for every row whose ``c`` is among ``values`` (their number known)
    and for few others: a Bloom filter as an array of 64-bit words, tested within the scan's stage."""
    bits = bloom_bits(count)
    value = F.col(f"`{values.columns[0]}`").cast("string")
    ones = values.where(value.isNotNull()).select(F.explode(F.array(*_bit_places(value, bits))).alias("p")).select(
        F.expr("p div 64").alias("word"), F.expr("shiftleft(1L, CAST(p % 64 AS INT))").alias("x"))
    words = ones.unionByName(values.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("x")))
    whole = words.groupBy("word").agg(F.bit_or("x").alias("x")).agg(
        F.expr("transform(sort_array(collect_list(struct(word, x))), w -> w.x)")).scalar()
    hits = [F.bit_get(F.element_at(whole, (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int")) == 1 for p in _bit_places(c.cast("string"), bits)]
    return reduce(lambda a, b: a & b, hits)


def _pruned(df: DataFrame, source_files: ListArg, ads: ListArg, campaigns: ListArg) -> DataFrame:
    """``df`` without most rows that the value tables among the lists cannot keep (one job a table counts it)."""
    for c, v in (("source_file", source_files), ("ad_name", ads), (resolve_campaign(df.columns), campaigns)):
        if c is not None and isinstance(v, DataFrame):
            known = staged_table(v.select(F.col(f"`{v.columns[0]}`").alias("v")).where("v IS NOT NULL").distinct(), "filter_values")
            if n := known.count():
                df = df.where(may_contain(known, F.col(f"`{c}`"), n))
    return df


def filter_ads(df: DataFrame, date_range=ALL_DATES, source_files: ListArg = None,
               ads: ListArg = None, campaigns: ListArg = None, long_lists: bool = False) -> DataFrame:
    """Filter the ad table.

    Python lists become ``IN`` predicates (Catalyst turns long ones into a
    hash ``InSet`` and pushes them into the scan). A DataFrame of values is
    applied as a join with its distinct values instead, for lists too large
    to ship in the plan; the join strategy is chosen by AQE from the measured
    size of the value table. An empty list or value table means no filter.
    ``long_lists=True`` is for value tables too long to broadcast: a Bloom filter of the values
    drops most other rows before the join's shuffle, the join stays exact.
    """
    pred = filter_predicate(df, date_range, source_files, ads, campaigns)
    out = df.where(pred) if pred is not None else df
    out = _pruned(out, source_files, ads, campaigns) if long_lists else out
    marked, listed = _marked(out, source_files, ads, campaigns)
    return marked.where(listed).select(*[F.col(f"`{c}`") for c in df.columns]) if listed is not None else out


def _marked(df: DataFrame, source_files: ListArg, ads: ListArg, campaigns: ListArg) -> tuple[DataFrame, Column | None]:
    """``df`` joined with the value tables among the lists, and whether a row
    is in all of them (null without value tables; an empty one holds for all)."""
    listed = None
    for i, (c, v) in enumerate((("source_file", source_files), ("ad_name", ads),
                                (resolve_campaign(df.columns), campaigns))):
        if c is not None and isinstance(v, DataFrame):
            vals = v.select(F.col(v.columns[0]).alias(f"_value{i}")).where(F.col(f"_value{i}").isNotNull()).distinct()
            empty = vals.agg(F.count(F.lit(1)) == 0).scalar()
            df = df.join(vals, F.col(f"`{c}`") == F.col(f"_value{i}"), "left")
            here = empty | F.col(f"_value{i}").isNotNull()
            listed = here if listed is None else listed & here
    return df, listed


def options(df: DataFrame, column: str) -> DataFrame:
    """distinct non-null values of a column in code-point order."""
    return (df.select(column).where(F.col(column).isNotNull()).distinct()
            .orderBy(column))


def filter_summary(df: DataFrame, date_range=ALL_DATES, source_files: ListArg = None,
                   ads: ListArg = None, campaigns: ListArg = None) -> DataFrame:
    """F8: one row (kept_rows, total_rows) from a single pass over the base;
    the lists are those of :func:`filter_ads`, value tables included."""
    pred = filter_predicate(df, date_range, source_files, ads, campaigns)
    marked, listed = _marked(df, source_files, ads, campaigns)
    both = [p for p in (pred, listed) if p is not None]
    kept = F.count_if(both[0] & both[-1]) if both else F.count(F.lit(1))
    return marked.agg(kept.alias("kept_rows"), F.count(F.lit(1)).alias("total_rows"))


# the deterministic preview order: provenance and dates first, then the rest
PREVIEW_KEYS = ("source_file", "reporting_starts", "reporting_ends", "ad_name")


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """the first ``n`` rows in a total order (top-k, not a global sort:
    Spark plans ``orderBy().limit()`` as TakeOrderedAndProject)."""
    keys = [c for c in PREVIEW_KEYS if c in df.columns]
    rest = [c for c in df.columns if c not in keys]
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in keys + rest]).limit(n)


def describe_columns(df: DataFrame) -> DataFrame:
    """(position, name, display_name, data_type, filled) of the table's
    columns; ``filled`` counts the rows that have a value, all columns in one pass."""
    display = {v: k for k, v in SNAKE.items()}
    counts = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"_f{i}") for i, f in enumerate(df.schema.fields)])
    rows = [F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("name"),
                     F.lit(display.get(f.name, f.name)).alias("display_name"),
                     F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"_f{i}").alias("filled"))
            for i, f in enumerate(df.schema.fields)]
    return counts.select(F.inline(F.array(*rows)))


__all__ = [
    "ALL_DATES", "AD_COLUMNS", "date_bounds", "date_predicate", "filter_predicate",
    "filter_ads", "options", "filter_summary", "preview", "describe_columns",
    "resolve_campaign",
]
