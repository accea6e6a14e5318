"""The three divide-by-zero rules of the report.

They are deliberately different and must not be merged:

* ``ratio_or_zero`` (overall KPIs): 0 unless the denominator is > 0.
* ``ratio_signed_inf`` (breakdowns): 0/0 -> 0, x/0 -> +-inf.
* ``ratio_text_or_na`` (summary text): ``N/A`` unless the denominator is > 0.

Spark runs with ANSI semantics, where a bare ``x / 0`` raises; every
division here sits behind a ``when`` guard, which is evaluated lazily.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def ratio_or_zero(num: Column, den: Column, scale: float | None = None) -> Column:
    q = num / den
    if scale is not None:
        q = q * F.lit(scale)
    return F.when(den > 0, q).otherwise(F.lit(0.0))


def ratio_signed_inf(num: Column, den: Column, scale: float | None = None) -> Column:
    q = num / den
    if scale is not None:
        q = q * F.lit(scale)
    return (
        F.when(den != 0, q)
        .when(num == 0, F.lit(0.0))
        .when(num > 0, F.lit(INF))
        .otherwise(F.lit(-INF))
    )


def ratio_text_or_na(num: Column, den: Column, render, scale: float | None = None) -> Column:
    """``render`` turns the double ratio into text (see ``adlens.functions.text``)."""
    q = num / den
    if scale is not None:
        q = q * F.lit(scale)
    return F.when(den > 0, render(q)).otherwise(F.lit("N/A"))
