"""Equi-joins with SQL semantics: duplicates on either side multiply."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import estimated_bytes, table_bytes

#: Broadcast only what is below this many bytes by the optimizer's estimate and as a table in memory.
BROADCAST_LIMIT = 64 << 20

HINTS = {"hash": "shuffle_hash", "merge": "merge"}


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """`df` marked for broadcast if its size permits, else for a join that shuffles, whose rows are the same.

    The estimate is of files, which can be many times smaller than their rows; so what it lets pass is
    counted, and what then is too large is kept from Spark's own broadcasts, which go by it as well."""
    if estimated_bytes(df) > limit:
        return df
    return F.broadcast(df) if table_bytes(df) <= limit else df.hint("merge")


def join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str] | Column | list[Column],
    how: str = "inner",
    strategy: str = "auto",
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Join with a strategy: auto, hash, merge, or broadcast (of the right side, size checked)."""
    if strategy == "broadcast":
        right = sized_broadcast(right, limit)
    elif strategy != "auto":
        right = right.hint(HINTS[strategy])
    return left.join(right, on, how)


def semi_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of `left` that have a match, once each (EXISTS)."""
    return left.join(right, on, "left_semi")


def prefilter(probe: DataFrame, build: DataFrame, key: str) -> DataFrame:
    """Exact semi-join reduction of `probe` before a larger join."""
    return semi_join(probe, build.select(key).distinct(), key)


def bloom_session(spark: SparkSession, least_scan: str = "10GB", most_build: str = "10MB") -> SparkSession:
    """A twin of `spark`, with its settings, for joins that shuffle: before the exchange they drop
    probe rows whose key is not in a Bloom filter of the build side's keys. Spark builds it where the
    probe side scans at least `least_scan` and the build side, cut by a selective filter, is
    estimated at `most_build` or less; spark.sql.optimizer.runtime.bloomFilter.maxNumBits bounds it.
    Rows that pass by mistake find no partner in the join itself, so the answer is exact."""
    twin = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    twin.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    twin.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    twin.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", least_scan)
    twin.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", most_build)
    return twin
