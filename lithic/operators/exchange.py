"""Placement of rows over partitions. None of these drops or repeats a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .join import sized_broadcast


def scatter(df: DataFrame, partitions: int) -> DataFrame:
    """Even round-robin split."""
    return df.repartition(partitions)


def hash_partition(df: DataFrame, partitions: int, *keys: str | Column) -> DataFrame:
    return df.repartition(partitions, *keys)


def range_partition(df: DataFrame, partitions: int, *keys: str | Column) -> DataFrame:
    """Ranges from sampled bounds, so uneven keys still give even partitions."""
    return df.repartitionByRange(partitions, *keys)


def replicate(df: DataFrame) -> DataFrame:
    """A copy on every executor at the next join, if the size permits."""
    return sized_broadcast(df)


def gather(df: DataFrame) -> DataFrame:
    """One partition. For results that are small by construction only."""
    return df.coalesce(1)


def with_partition(df: DataFrame, name: str = "part") -> DataFrame:
    return df.withColumn(name, F.spark_partition_id())


def salted(df: DataFrame, salts: int, *columns: str, name: str = "salt") -> DataFrame:
    """A deterministic salt from other columns, to split a hot key before an exchange on (key, salt)."""
    return df.withColumn(name, F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int"))
