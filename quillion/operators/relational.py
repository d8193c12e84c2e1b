"""The engine's operators as functions on DataFrames; each adds to the logical plan and Catalyst plans them together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Comparison operators, join types and aggregates by their SQL names.
COMPARISONS = ("=", "!=", "<>", "<", ">", "<=", ">=")
JOINS = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full"}
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: Any


@dataclass(frozen=True)
class Aggregate:
    """function of a column, or COUNT of ``*``."""

    function: str
    column: str
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or f"{self.function.lower()}_{self.column}"


@dataclass(frozen=True)
class SortKey:
    column: str
    descending: bool = False


def condition(df: DataFrame, c: Condition) -> Column:
    """A comparison with a literal. Null, and a value that does not compare with the literal, is not true."""
    if c.operator not in COMPARISONS:
        raise ValueError(f"Unknown operator '{c.operator}'")
    kind, left = df.schema[c.column].dataType, F.col(f"`{c.column}`")
    if isinstance(kind, T.StringType) and isinstance(c.value, (int, float)) and not isinstance(c.value, bool):
        left = left.try_cast("double")
    elif isinstance(kind, T.NumericType) and isinstance(c.value, str):
        return F.coalesce(_compare(left, c.operator, F.lit(c.value).try_cast("double")), F.lit(False))
    return F.coalesce(_compare(left, c.operator, F.lit(c.value)), F.lit(False)) if c.value is not None else F.lit(False)


def _compare(left: Column, operator: str, right: Column) -> Column:
    return {
        "=": left == right, "!=": left != right, "<>": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right,
    }[operator]


def filter_rows(df: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """Rows for which all conditions are true; plain comparisons are pushed into the scan."""
    for c in conditions:
        left = F.col(f"`{c.column}`")
        kind = df.schema[c.column].dataType
        plain = isinstance(kind, T.NumericType) and isinstance(c.value, (int, float)) or isinstance(kind, T.StringType) and isinstance(c.value, str)
        df = df.where(_compare(left, c.operator, F.lit(c.value)) if plain and c.operator in COMPARISONS else condition(df, c))
    return df


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df if list(columns) == ["*"] else df.select(*[F.col(c) for c in columns])


def limit(df: DataFrame, n: int) -> DataFrame:
    if n < 0:
        raise ValueError("LIMIT must not be negative")
    return df.limit(n)


def aggregate(a: Aggregate) -> Column:
    kind = a.function.upper()
    if kind not in AGGREGATES:
        raise ValueError(f"Unknown aggregate function '{a.function}'")
    if kind == "COUNT":
        return F.count(F.lit(1) if a.column == "*" else F.col(a.column)).alias(a.name)
    return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[kind](F.col(a.column)).alias(a.name)


def group_by(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Aggregate]) -> DataFrame:
    """One row a group, null a group of its own; without keys one row; without aggregates the distinct keys."""
    if not aggregates:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*map(aggregate, aggregates))


def order_by(df: DataFrame, keys: Sequence[SortKey]) -> DataFrame:
    """Nulls last, whichever way a key goes."""
    return df.orderBy(*[F.col(k.column).desc_nulls_last() if k.descending else F.col(k.column).asc_nulls_last() for k in keys])


def join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "INNER") -> DataFrame:
    """An equi-join; null keys never match, and a right column whose name is taken gets ``right_`` before it.

    Adaptive execution chooses between broadcast (by measured size), hash and merge joins, and splits skewed keys.
    """
    if how.upper() not in JOINS:
        raise ValueError(f"Unsupported join type '{how}'")
    taken = {c.lower() for c in left.columns}
    names = []
    for c in right.columns:
        while c.lower() in taken:
            c = f"right_{c}"
        taken.add(c.lower())
        names.append(c)
    renamed = right.toDF(*names)
    return left.join(renamed, left[left_key] == renamed[names[right.columns.index(right_key)]], JOINS[how.upper()])


def result_filter(df: DataFrame, column: str, operator: str, value: Any = None, upper: Any = None) -> DataFrame:
    """A filter on a finished result: eq, gt, lt, between and is compare (numbers as numbers); contains, startswith, endswith,
    exact and regex match texts, whatever their case."""
    own = F.col(f"`{column}`")
    text, sought = F.lower(own.cast("string")), F.lit(str(value).lower())
    if operator in ("eq", "gt", "lt", "between"):
        number = isinstance(df.schema[column].dataType, T.NumericType)
        at = (lambda v: F.lit(str(v)).try_cast("double")) if number else (lambda v: F.lit(str(v).lower()))
        left = own.cast("double") if number else text
        if operator == "between":
            return df.where(left.between(at(value), at(upper)))
        return df.where(left == at(value) if operator == "eq" else left > at(value) if operator == "gt" else left < at(value))
    if operator == "is":
        wanted = str(value).lower()
        return df.where(own.isNull() if wanted == "null" else own.isNotNull() if wanted == "not null" else text == sought)
    if operator == "regex":
        return df.where(own.cast("string").rlike(f"(?i){value}"))
    made = {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}
    if operator == "exact":
        return df.where(text == sought)
    if operator not in made:
        raise ValueError(f"Unknown filter '{operator}'")
    return df.where(made[operator](text, sought))


def result_contains(df: DataFrame, value: str) -> DataFrame:
    """Rows of which any column has the text."""
    found = F.lit(False)
    for c in df.columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(f"`{c}`").cast("string")), F.lit(value.lower())), F.lit(False))
    return df.where(found)


def page(df: DataFrame, keys: Sequence[SortKey], number: int, size: int = 100) -> DataFrame:
    """A page of an ordered result, the first being 0."""
    return order_by(df, keys).offset(number * size).limit(size)
