"""Selection. A predicate is any boolean Column; NULL results drop the row (SQL rules)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_where(df: DataFrame, *predicates: Column) -> DataFrame:
    """Rows for which every predicate holds: one FilterExec however many are given."""
    return df.filter(reduce(lambda a, b: a & b, predicates)) if predicates else df


def in_closed(column: str, low, high) -> Column:
    return F.col(column).between(low, high)


def in_half_open(column: str, low, high) -> Column:
    return (F.col(column) >= low) & (F.col(column) < high)


def within(column: str | Column, centre: int, tolerance: int = 1) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.between(centre - tolerance, centre + tolerance)


def equals(column: str, literal) -> Column:
    return F.col(column) == F.lit(literal)


def contains(column: str, text: str) -> Column:
    return F.contains(F.col(column), F.lit(text))


def before(column: str, literal: Column) -> Column:
    return F.col(column) < literal


def after(column: str, literal: Column) -> Column:
    return F.col(column) > literal


def less_column(a: str, b: str) -> Column:
    return F.col(a) < F.col(b)
