"""Number -> display text, matching Python's ``format`` specs of the report.

``format_number`` rounds half-even on the binary value, like Python's
``{:,.2f}``; ``format_string('%.2f')`` rounds half-up and is not used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column) -> Column:
    """``${:,.2f}``"""
    return F.concat(F.lit("$"), F.format_number(c, 2))


def whole(c: Column) -> Column:
    """``{:,.0f}``"""
    return F.format_number(c, 0)


def plain2(c: Column) -> Column:
    """``{:.2f}`` (no thousands separator)."""
    return F.regexp_replace(F.format_number(c, 2), ",", "")


def money_plain(c: Column) -> Column:
    """``${:.2f}``"""
    return F.concat(F.lit("$"), plain2(c))


def percent_plain(c: Column) -> Column:
    """``{:.2f}%``"""
    return F.concat(plain2(c), F.lit("%"))


def iso_date(c: Column) -> Column:
    """``%Y-%m-%d``"""
    return F.date_format(c, "yyyy-MM-dd")
