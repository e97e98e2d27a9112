"""Ordering and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def order_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Global sort: a sampled range exchange and a local sort."""
    return df.orderBy(*keys)


def sort_local(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Sort inside each partition, without an exchange."""
    return df.sortWithinPartitions(*keys)


def top_k(df: DataFrame, k: int, *keys: str | Column) -> DataFrame:
    """First k rows; give keys that make the order total, or ties at the border are free.
    Planned as TakeOrderedAndProject: k rows from each task, no full sort."""
    return df.orderBy(*keys).limit(k)
