"""Parquet scans and sinks, in-memory tables, and seeded fixtures."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, directory: str, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Scan one Parquet table, reading only `columns` (the list reaches ReadSchema)."""
    df = spark.read.parquet(f"{directory}/{table}.parquet")
    return df.select(*columns) if columns else df


def with_optional(df: DataFrame, name: str, default: Column) -> DataFrame:
    """`df` with column `name`: its own where it has one, else `default`."""
    return df if name in df.columns else df.withColumn(name, default)


def write(df: DataFrame, path: str, schema: str | None = None, rows_per_file: int = 1_000_000) -> None:
    """Write Parquet, cast to a DDL schema if one is given; a file holds at most
    `rows_per_file` rows, so output files stay even without a shuffle."""
    if schema:
        target = df.sparkSession.createDataFrame([], schema).schema
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target])
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def to_host(df: DataFrame, most_rows: int = 1_000_000) -> pa.Table:
    """The rows as an Arrow table on the driver; ValueError, before more than that many are fetched, if
    there are more than `most_rows`."""
    out = df.limit(most_rows + 1).toArrow()
    if out.num_rows > most_rows:
        raise ValueError(f"more than {most_rows} rows: write them instead")
    return out


def from_rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """An in-memory table."""
    return spark.createDataFrame(list(rows), schema)


def uniform(spark: SparkSession, n: int, low: int, high: int, seed: int = 0, name: str = "key") -> DataFrame:
    """`n` rows of integers uniform on [low, high]; the same seed gives the same rows."""
    span = high - low + 1
    return spark.range(n).select((F.floor(F.rand(seed) * span) + low).cast("long").alias(name))


def permutation(spark: SparkSession, n: int, seed: int = 0, name: str = "key") -> DataFrame:
    """1..n, each once, in a seeded random order."""
    return spark.range(1, n + 1).orderBy(F.rand(seed)).select(F.col("id").alias(name))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; it reads file metadata, not data."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Bytes of a row in a hash table besides its fields: a header, a pointer and slots of which half or more are empty.
ROW_BYTES = 48


def table_bytes(df: DataFrame) -> int:
    """Bytes of the rows of `df` as a hash table in memory, by their number and the lengths of their texts.

    Runs `df` once, for columns of varying length and the number of rows; of files without such columns only footers are read."""
    rows = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    varying = [F.octet_length(f.name) if f.dataType.typeName() in ("string", "binary") else 8 * F.octet_length(F.col(f.name).cast("string")) for f in rows.schema if f.dataType.typeName() in ("string", "binary", "array", "map", "struct", "variant")]
    total = sum((F.coalesce(F.sum(x), F.lit(0)) for x in varying), F.lit(0))
    n, text = rows.agg(F.count(F.lit(1)), total).first()
    return n * (ROW_BYTES + 16 * len(rows.columns)) + text
