"""A1, A6, A8 and A11 under filters: a stored rollup that answers instead of the fact table.

The sums that those reports need add up, so one pass over the facts stores them at
several levels (days and deliveries; days, files and ads; ...). Days are always part of a level, as
the date filter looks at both. :meth:`Rollup.report` picks the level with the fewest
rows that has every column the filters and the report use and runs the
report over it; what no level covers goes to the fact table.

Null keys are values of their own (a cell of theirs), so rows without an ad or a date
count where they would in the fact table. Money is summed exactly in a cell.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.operators.breakdown import breakdown, spend_share
from adlens.operators.filters import ALL_DATES, filter_ads, resolve_campaign
from adlens.operators.kpis import funnel, kpi_cards, kpis, money_exact, money_joined, money_rest
from adlens.session import shared_dir, staged_table

DATES = ("reporting_starts", "reporting_ends")
DIMENSIONS = ("source_file", "ad_name", "campaign", "ad_delivery")
SUMS = ("impressions", "reach", "link_clicks", "clicks_all", "results")
LEVELS = ((), ("ad_delivery",), ("source_file", "ad_name"), ("source_file", "ad_name", "campaign", "ad_delivery"))
ROWS_A_TASK = 500_000

#: The reports whose numbers are sums of sums, and whether they group by a dimension.
REPORTS: dict[str, tuple[Callable, bool]] = {
    "kpis": (kpis, False), "kpi_cards": (kpi_cards, False), "funnel": (funnel, False),
    "breakdown": (breakdown, True), "spend_share": (spend_share, True)}


@dataclass
class Rollup:
    """A stored rollup of ``facts``: ``levels`` holds (dimensions, rows, folder), smallest first."""

    facts: DataFrame
    levels: list[tuple[tuple[str, ...], int, str]]

    def covering(self, columns: set[str]) -> str | None:
        """The folder of the smallest level with all the columns."""
        return next((folder for dims, _, folder in self.levels if columns <= {*dims, *DATES}), None)

    def source(self, columns: set[str]) -> DataFrame:
        folder = self.covering(columns)
        return self.facts if folder is None else self.facts.sparkSession.read.parquet(folder)

    def report(self, name: str, dim: str | None = None, date_range=ALL_DATES, source_files=None, ads=None, campaigns=None) -> DataFrame:
        """The report ``name`` (of ``REPORTS``) over the rows that the filters keep; ``dim`` for those by dimension."""
        build, grouped = REPORTS[name]
        used = {c for c, v in (("source_file", source_files), ("ad_name", ads), (resolve_campaign(self.facts.columns), campaigns))
                if v is not None and c is not None}
        table = self.source(used | ({dim} if grouped else set()))
        kept = filter_ads(table, date_range=date_range, source_files=source_files, ads=ads, campaigns=campaigns)
        return build(kept, dim) if grouped else build(kept)


def _dealt(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` dealt by ``keys`` to as many tasks as their number asks for."""
    return rows.repartition(max(1, -(-rows.count() // ROWS_A_TASK)), *keys)


def build_rollup(facts: DataFrame, levels: Sequence[Sequence[str]] = LEVELS, folder: str | None = None) -> Rollup:
    """Store the levels of ``facts`` (one scan) below ``folder``, by default a fresh one in the shared folder."""
    folder = folder or f"{shared_dir(facts.sparkSession)}/adlens_rollup_{uuid.uuid4().hex}"
    levels = [tuple(x) for x in levels]
    if bad := {c for x in levels for c in x} - set(DIMENSIONS):
        raise ValueError(f"not a dimension: {sorted(bad)}")
    # the facts are read and shuffled once, into cells with every column of a level; the levels are sums of cells.
    # Both are dealt by their number of rows, so that what a task sums up does not grow with the table
    keys = [*DATES, *(c for c in DIMENSIONS if any(c in x for x in levels))]
    sums = {"rows": F.count(F.lit(1)), "_exact": F.sum(money_exact(F.col("spend"))), "_rest": F.sum(money_rest(F.col("spend"))),
            **{c: F.sum(c) for c in SUMS}}
    cells = staged_table(_dealt(facts.select(*keys, "spend", *SUMS), keys).groupBy(*keys).agg(
        *[e.alias(c) for c, e in sums.items()]), "rollup_cells")
    spark = facts.sparkSession
    found = []
    for i, dims in enumerate(levels):
        own, path = [*DATES, *dims], f"{folder}/level_{i}"
        rows = _dealt(cells, own).groupBy(*own).agg(*[F.sum(c).alias(c) for c in sums])
        absent = {c: F.lit(None).cast(facts.schema[c].dataType) for c in DIMENSIONS if c not in dims}
        rows.select(*DATES, *[absent.get(c, F.col(c)).alias(c) for c in DIMENSIONS], "rows",
                    money_joined(F.col("_exact"), F.col("_rest")).alias("spend"), *SUMS).write.mode("overwrite").parquet(path)
        found.append((dims, spark.read.parquet(path).count(), path))
    return Rollup(facts, sorted((f for f in found if f[1]), key=lambda f: f[1]))
