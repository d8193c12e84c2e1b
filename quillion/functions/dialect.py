"""The dialect's functions as expressions, for the DataFrame API; SQL text gets the same from ``plans.sqltext``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.sqltext import strftime_pattern


def concat(*columns: Column) -> Column:
    """Nulls are left out."""
    return F.concat_ws("", *columns)


def split(column: Column, delimiter: str) -> Column:
    """At a plain text, not a pattern."""
    return F.split(column, rf"\Q{delimiter}\E")


def strftime(column: Column, pattern: str) -> Column:
    return F.date_format(column, strftime_pattern(pattern))


def regexp_matches(column: Column, pattern: str) -> Column:
    return F.regexp_like(column, F.lit(pattern))


def date_diff(unit: str, start: Column, end: Column) -> Column:
    """Boundaries of the unit between two dates (day, month, quarter or year), or whole weeks."""
    if unit == "day":
        return F.datediff(end, start).cast("long")
    if unit == "week":
        return (F.datediff(end, start) / 7).cast("long")
    if unit == "year":
        return (F.year(end) - F.year(start)).cast("long")
    per, part = {"month": (12, F.month), "quarter": (4, F.quarter)}[unit]
    return (F.year(end) * per + part(end) - F.year(start) * per - part(start)).cast("long")
