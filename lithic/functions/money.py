"""Scaled-integer money and the date literals of the five queries.

Amounts arrive as doubles. `cents` rounds once, at the scan; sums of scaled
longs are exact and do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(column: str | Column) -> Column:
    return F.round((F.col(column) if isinstance(column, str) else column) * 100).cast("long")


def day(text: str) -> Column:
    """A literal that compares with timestamp_ntz columns without casting them, so that
    the predicate still reaches the Parquet reader."""
    return F.lit(text).cast("timestamp_ntz")


def revenue(price: Column, discount: Column) -> Column:
    """price x (100 - discount), scaled by 10^4."""
    return price * (F.lit(100) - discount)


def charge(price: Column, discount: Column, tax: Column) -> Column:
    """revenue x (100 + tax), scaled by 10^6."""
    return revenue(price, discount) * (F.lit(100) + tax)


def whole_quotient(a: str, b: str) -> Column:
    """Integer division of two columns that truncates toward zero; never through a double."""
    return F.expr(f"`{a}` div `{b}`")


def packed_date(date: Column) -> Column:
    """day + (month << 5) + ((year - 1900) << 9): an int that sorts as the date does."""
    return F.dayofmonth(date) + F.shiftleft(F.month(date), 5) + F.shiftleft(F.year(date) - 1900, 9)
