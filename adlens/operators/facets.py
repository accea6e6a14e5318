"""F6 and F8 as facets: a bitmap index of the filter columns.

One pass numbers the rows and stores, for each value of each column and each
block of 32,768 row numbers, the bitmap of its rows (in the layout of the built-in bitmap functions).
A task's rows have consecutive numbers, so it finishes one block after the other: nothing is sorted or
shuffled, and a task holds one block. A filter is then the OR of its values' bitmaps, several filters the AND of
those, block by block; counts are set bits. The fact table is not read again, and blocks are independent, so
the work is spread however many rows one value has.

:func:`facet_counts` gives the values that can still be chosen in each column with the
number of rows each would keep, given the filters on the *other* columns.

Null is no value (it cannot be chosen); an empty or missing list is no filter; values that do
not occur choose nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.session import ship_package

COLUMNS = ("source_file", "ad_name", "campaign", "ad_delivery")
BLOCK = 32_768  # rows of a bitmap, as in the built-in functions
BITMAPS_A_BATCH = 256
BITMAPS_A_TASK = 8_192  # 32 MB


def bitmap_index(df: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """(column, value, block, bits); the rows themselves are the column ``*`` with a null value."""
    ship_package(df.sparkSession)
    # all bitmaps of a row are made from one number of it, so they agree whatever the numbers are
    numbered = df.select(F.monotonically_increasing_id().alias("_row"), *[
        F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    numbered = numbered.select(F.bitmap_bucket_number("_row"), F.bitmap_bit_position("_row"), *numbered.columns[1:])
    return numbered.mapInArrow(_block_bitmaps(tuple(columns)), "column string, value string, block long, bits binary")


def _block_bitmaps(columns: tuple[str, ...]):
    """Rows (block, position, values), in order, to the bitmaps of their blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1, append=blocks[-1:] + 1)) if len(blocks) else []
            for a, b in zip(edges[:-1], edges[1:]):
                if held and blocks[a] != block:
                    yield from _bitmaps(columns, block, held)
                    held = []
                block = blocks[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from _bitmaps(columns, block, held)
    return run


def _bitmaps(columns: tuple[str, ...], block: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).combine_chunks()
    place = rows.column(1).to_numpy()
    for name, i in [("*", None), *((c, i) for i, c in enumerate(columns, 2))]:
        if i is None:
            values, codes, own = [None], np.zeros(len(place), np.int64), place
        else:
            coded = rows.column(i).combine_chunks().dictionary_encode()
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            there = coded.is_valid().to_numpy(zero_copy_only=False)
            values, codes, own = coded.dictionary.to_pylist(), coded.indices.fill_null(-1).to_numpy()[there], place[there]
        order = np.argsort(codes, kind="stable")
        codes, own = codes[order], own[order]
        for first in range(0, len(values), BITMAPS_A_BATCH):
            some = values[first: first + BITMAPS_A_BATCH]
            a, b = np.searchsorted(codes, [first, first + len(some)])
            marks = np.zeros((len(some), BLOCK), bool)
            marks[codes[a:b] - first, own[a:b]] = True
            bits = np.packbits(marks, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some), pa.string()), pa.array(some, pa.string()),
                 pa.array([int(block)] * len(some), pa.int64()), pa.array([x.tobytes() for x in bits], pa.binary())],
                names=["column", "value", "block", "bits"])


def _dealt(index: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Deals bitmaps to tasks by block, by their size in memory: sparse ones take a small part of it
    on disk, so adaptive execution would let a task sort far more."""
    n = max(1, -(-index.count() // BITMAPS_A_TASK))
    return lambda df: df.repartition(n, "block")


def _chosen(index: DataFrame, column: str, values: Sequence[str], dealt: Callable) -> DataFrame:
    """(block, chosen): the rows that hold one of the values of a column."""
    own = index.where((F.col("column") == column) & F.col("value").isin(list(values)))
    return dealt(own.select("block", "bits")).groupBy("block").agg(F.bitmap_or_agg("bits").alias("chosen"))


def _all_of(index: DataFrame, filters: Mapping[str, Sequence[str]], dealt: Callable) -> DataFrame:
    """(block, chosen): the rows that pass every filter; blocks without any are left out."""
    parts = [_chosen(index, c, v, dealt) for c, v in filters.items()]
    if not parts:
        return index.where(F.col("column") == "*").select("block", F.col("bits").alias("chosen"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return dealt(whole).groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.bitmap_and_agg("chosen").alias("chosen")).where(
        F.col("n") == len(parts)).select("block", "chosen")


def _given(filters: Mapping[str, Sequence[str] | None]) -> dict[str, Sequence[str]]:
    return {c: list(v) for c, v in filters.items() if v}


def kept_count(index: DataFrame, filters: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """F8 from the index: one row (kept_rows, total_rows)."""
    kept = _all_of(index, _given(filters), _dealt(index)).agg(F.coalesce(F.sum(F.bitmap_count("chosen")), F.lit(0)).alias("kept_rows"))
    total = index.where(F.col("column") == "*").agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).scalar()
    return kept.withColumn("total_rows", total)


def facet_counts(index: DataFrame, filters: Mapping[str, Sequence[str] | None], columns: Sequence[str] = COLUMNS) -> DataFrame:
    """F6 with counts: (column, value, rows) of the values that keep rows under the other columns' filters."""
    out, dealt = None, _dealt(index)
    for c in columns:
        others = {k: v for k, v in _given(filters).items() if k != c}
        own = index.where(F.col("column") == c).select("column", "value", "block", "bits")
        if others:
            both = own.unionByName(own.select("column", "value", "block").join(_all_of(index, others, dealt), "block").withColumnRenamed(
                "chosen", "bits"))
            own = dealt(both).groupBy("column", "value", "block").agg(F.count(F.lit(1)).alias("n"), F.bitmap_and_agg("bits").alias("bits")).where("n = 2")
        found = own.groupBy("column", "value").agg(F.sum(F.bitmap_count("bits")).alias("rows")).where("rows > 0")
        out = found if out is None else out.unionByName(found)
    return out.orderBy("column", "value")
