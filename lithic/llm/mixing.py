"""Pfair interleaving of sources by target weights.

Each source's rows form blocks of equal size. Block j (from 0) of a source of weight w has
release floor(j / w) and deadline ceil((j + 1) / w); one block runs per slot, always the
released one of earliest deadline. Weights are whole shares of a period, so this schedule
repeats after each period and every source is within one block of its share at any slot.
The plan computes one period from the weights alone; rows find their slot by arithmetic.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions


#: Leading bits of a row's digest that order it.
DIGEST_BITS = 60


@dataclass(frozen=True)
class Mixing:
    #: Weight of each source; None means weights in proportion to size ** temper.
    weights: Mapping[str | None, float] | None = None
    temper: float = 0.5
    #: Characters in a block.
    block: int = 1 << 16
    #: Slots in a period, at least: with more sources than half of it, it is twice their number. A plan holds this many numbers.
    period: int = 1000
    seed: int = 7


def shares(weights: Mapping, period: int) -> dict:
    """Whole slots per period by largest remainder, at least one each, summing to the period."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources need a period of at least as many slots")
    total = sum(weights.values())
    exact = {s: max(1.0, w * period / total) for s, w in weights.items()}
    scale = period / sum(exact.values())
    out = {s: max(1, int(x * scale)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: int(exact[s] * scale) - exact[s] * scale)
    while (short := period - sum(out.values())) > 0:
        for s in order[:short]:
            out[s] += 1
    # What the smallest sources have too much comes from the largest, one slot at a time.
    largest = [(-n, k, s) for k, (s, n) in enumerate(out.items())]
    heapq.heapify(largest)
    for _ in range(sum(out.values()) - period):
        n, k, s = largest[0]
        out[s] -= 1
        heapq.heapreplace(largest, (n + 1, k, s))
    return out


def schedule(share: Mapping, period: int) -> dict:
    """For each source the slots of its blocks in one period: earliest deadline first among the released."""
    waiting = [(0, i) for i, _ in enumerate(share)]  # release, source
    names, made = list(share), [0] * len(share)
    ready: list[tuple[int, int]] = []
    out: dict = {s: [] for s in names}
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(made[i] + 1) * period // share[names[i]]), i))
        if not ready:
            continue
        deadline, i = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline was missed")
        out[names[i]].append(slot)
        made[i] += 1
        if made[i] < share[names[i]]:
            heapq.heappush(waiting, (made[i] * period // share[names[i]], i))
    return out


#: A plan is made on the driver, some hundred bytes a source.
MOST_SOURCES = 1_000_000


def source_sizes(docs: DataFrame, source: str, size: Column) -> dict:
    """Total size by source: one number each, of at most MOST_SOURCES sources; beyond them it raises."""
    found = docs.groupBy(F.col(source).alias("s")).agg(F.sum(size).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them first")
    return {r.s: r.n for r in found}


#: A plan of at most so many sources and slots, some 20 bytes each, is broadcast; a larger one is joined like any table.
BROADCAST_NUMBERS = 500_000


def listed(weights: Mapping) -> dict:
    """In order of name, null last: ties between sources must not depend on the order in which their sizes arrive."""
    return dict(sorted(weights.items(), key=lambda w: (w[0] is None, w[0] or "")))


def mix(docs: DataFrame, p: Mixing = Mixing(), source: str = "source", text: str = "text", key: str = "doc_id", carry: list[str] | None = None, ordered: bool = False) -> DataFrame:
    """the_row (all columns of `docs`, or those in `carry`), source, size, block, slot, place.

    The order of the mixture is (slot, place); `ordered` sorts and range-partitions by it.
    A slot belongs to one source's block. Once a source has no more blocks its slots stay
    empty, so the others keep their proportions; no row is dropped. A null source is a source
    of its own. Null or empty text has size 1, so that every row advances the schedule; a text
    longer than a block takes the slot of the block it starts in and the following blocks start
    late. Rows of a source stand in the order of a digest of seed and id, which any engine can
    compute and which no number of partitions changes; rows that repeat an id are ordered by a
    hash of their text, and equal rows come in any order. An empty table gives no rows. Columns
    of `docs` cannot clash: they travel inside the_row.
    """
    spark = docs.sparkSession
    # A bucket is a range of digests, so buckets in turn, and rows inside them, are in the order of the digest.
    bits = max(1, (4 * partitions(spark) - 1).bit_length())
    size = F.greatest(F.coalesce(F.length(F.col(text)), F.lit(0)), F.lit(1)).cast("long")
    weights = p.weights
    if weights is None:
        weights = {s: n**p.temper for s, n in source_sizes(docs, source, size).items()}
    if not weights:
        weights = {None: 1.0}
    weights = listed(weights)
    period = max(p.period, 2 * len(weights))
    share = shares(weights, period)
    slots = schedule(share, period)
    plan = spark.createDataFrame([(s, share[s], slots[s]) for s in share], "plan_source string, share long, slots array<int>")

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("the_row"), F.col(source).cast("string").alias("source"), F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("tie"), size.alias("size"))
    digest = F.md5(F.concat_ws("|", F.lit(str(p.seed)), F.col("key").cast("string")))
    rows = rows.withColumn("order", F.conv(F.substring(digest, 1, DIGEST_BITS // 4), 16, 10).cast("long"))
    rows = rows.withColumn("bucket", F.shiftright("order", DIGEST_BITS - bits).cast("int"))
    # A hot source is spread over buckets; only bucket totals meet in one place.
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    # With a null-safe key of two columns that are never null, null sources join too.
    named = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    before = Window.partitionBy("named").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(named.alias("named"), "bucket", "total").select("named", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("named", "bucket").orderBy("order", "key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("named", named).withColumn("earlier", F.coalesce(F.sum("size").over(inside), F.lit(0))).drop("tie", "order", "key")
    rows = rows.join(bases, ["named", "bucket"])
    rows = rows.withColumn("start", F.col("base") + F.col("earlier")).withColumn("block", F.expr(f"start div {p.block}"))
    small = len(share) + period <= BROADCAST_NUMBERS
    rows = rows.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("plan_source")))
    slot = F.expr(f"(block div share) * {period}L + element_at(slots, CAST(block % share AS INT) + 1)")
    out = rows.select("the_row", "source", "size", "block", slot.alias("slot"), F.expr(f"start % {p.block}").alias("place"))
    if ordered:
        out = out.repartitionByRange(partitions(spark), "slot", "place").sortWithinPartitions("slot", "place")
    return out
