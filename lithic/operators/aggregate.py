"""Grouped and scalar aggregation; Spark plans partial and final steps by itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reduce_sum(df: DataFrame, value: Column, name: str = "total") -> DataFrame:
    """SUM over the table; NULL for an empty one."""
    return df.agg(F.sum(value).alias(name))


def aggregate(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs)


def aggregate_sorted(df: DataFrame, keys: Sequence[str], *aggs: Column, partitions: int | None = None) -> DataFrame:
    """The same answer, clustered by key and sorted inside each partition. Rows are summed before
    they are exchanged, so a hot key is one row of each task."""
    out = df.groupBy(*keys).agg(*aggs)
    return (out.repartition(partitions, *keys) if partitions else out).sortWithinPartitions(*keys)


def unique(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def sum_by(df: DataFrame, value: str | Column, *keys: str, name: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(name))


def mean_by(df: DataFrame, value: str | Column, *keys: str, name: str = "mean") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(name))


def count_column_by(df: DataFrame, column: str, *keys: str, name: str = "n") -> DataFrame:
    """COUNT(column): rows where it is not NULL."""
    return df.groupBy(*keys).agg(F.count(column).alias(name))


def count_distinct_by(df: DataFrame, column: str, *keys: str, name: str = "n") -> DataFrame:
    """COUNT(DISTINCT column) as two aggregations, so that a hot group is spread by value."""
    return unique(df, *keys, column).groupBy(*keys).agg(F.count(column).alias(name))


def dedupe_then_count(df: DataFrame, column: str, *keys: str, name: str = "n") -> DataFrame:
    """Rows left per key after duplicates of `column` go; `keys` must depend on `column`."""
    return df.dropDuplicates([column]).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
