"""Splitting the postings of a set-similarity join by set size.

Sets of similarity t have sizes within a ratio of t, and at their first common posting what
follows it in both must still hold the needed overlap. So a row of a posting is dealt to
the size bands of its possible partners, and to a band only if it can still reach what
the smallest set of that band asks for. Texts that share a notice and fall short of the threshold
drop out here, before any pair is made.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 1.05  # ratio of the sizes at the ends of a band


def band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(STEP)).cast("int")


def to_partner_bands(rows: DataFrame, t: int) -> DataFrame:
    """``rows`` (with n, the size, and place, what comes before the posting) once for each ``band`` of partners."""
    least, most = F.expr(f"(n * {t} + 99) div 100"), F.expr(f"(n * 100) div {t}")
    dealt = rows.withColumn("band", F.explode(F.sequence(band(least), band(most))))
    smallest = F.greatest(least, F.ceil(F.pow(F.lit(STEP), F.col("band"))) - 1)
    needed = F.floor((F.lit(t) * (F.col("n") + smallest) + 99 + t) / (100 + t))
    return dealt.where(F.col("n") - F.col("place") >= needed)
