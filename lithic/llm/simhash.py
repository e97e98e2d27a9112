"""Near duplicates by SimHash, found through a grid over segment bit counts.

A fingerprint's 64 bits are 32 segments of two; its embedding is the vector of their bit
counts. The Manhattan distance of two embeddings is at most the Hamming distance of the
fingerprints, so fingerprints within 3 bits have embeddings within 3, and of the two halves
of 16 segments at least one is within 1. The grid's cells are half vectors: each
fingerprint stands in its two cells and asks there and in the cells one step up (one side
of a step is enough, the other asks back). What meets is verified on the bits.

Texts with equal fingerprints are one class before all that; classes, not documents, are
linked: first with a few hubs of their cells, then with classes that this left apart.
Components come from alternating star contraction over the links, and in one task once those are few.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, moved, scratch_scope, sliced, small_batches, text_or_empty, unique_ids

WORDS = 3
SEED = 42
MAX_BITS = 3
#: Another order of fingerprints, for a third hub.
TURN = 0x2545F4914F6CDD1D
#: Rows of 64 bits that are counted at once.
BLOCK = 1 << 14
#: Graphs of so many edges at most, a quarter of a megabyte, are solved in one task; more are contracted by joins until so few are left, or to the end.
SMALL_GRAPH = 1 << 14


def majority(h: np.ndarray) -> int:
    """Bit i is set if more than half of the hashes have it; 0 without any."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), BLOCK):
        bits = np.unpackbits(h[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str) -> int:
    """The majority of the shingles' hashes; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(size) - size
    k = min(WORDS, len(words))
    ends = (start + size - 1)[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start.tolist(), ends)), np.uint64, len(ends)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row, without any exchange."""

    def run(batches):
        for b in sliced(batches, 512):
            made = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


def cell(fp: Column, half: int) -> Column:
    """Bit counts of the 16 two-bit segments of one half, packed two bits each."""
    x = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
    return x - F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x55555555))


def _cells(classes: DataFrame) -> DataFrame:
    both = F.array(*[F.struct(F.lit(i).alias("half"), cell(F.col("fp"), i).alias("cell")) for i in (0, 1)])
    return classes.select(*classes.columns, F.explode(both).alias("c")).select(*classes.columns, "c.half", "c.cell")


def hub_links(classes: DataFrame) -> DataFrame:
    """Pairs (u, v), u > v, of a cell's smallest, its largest and a third fingerprint with those of
    the same cell within MAX_BITS: enough to join most of a large family without all of its pairs."""
    home = _cells(classes.select("fp"))
    turned = F.col("fp").bitwiseXOR(F.lit(TURN))
    hubs = home.groupBy("half", "cell").agg(F.min("fp").alias("m0"), F.max("fp").alias("m1"), F.min(turned).bitwiseXOR(F.lit(TURN)).alias("m2")).where("m0 < m1")
    hubs = hubs.select("half", moved("cell", "m0").alias("cell"), "m0", "m1", "m2")
    met = home.join(hubs, ["half", "cell"]).select("fp", F.explode(F.array("m0", "m1", "m2")).alias("hub"))
    met = met.where((F.col("fp") != F.col("hub")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= MAX_BITS))
    return met.select(F.greatest("fp", "hub").alias("u"), F.least("fp", "hub").alias("v")).distinct()


def _meetings(classes: DataFrame) -> DataFrame:
    """fp, root and fp2, root2 that the grid brings together, in 1 to MAX_BITS bits apart and of different roots."""
    home = _cells(classes.select("fp", "root"))
    # One step up in a segment is a carry-free increment of its field, possible below a count of 2.
    up = "transform(filter(sequence(0, 15), k -> shiftright(cell, 2 * k) & 3 < 2), k -> cell + shiftleft(1L, 2 * k))"
    asks = home.select(F.col("root").alias("root2"), F.col("fp").alias("fp2"), F.col("half").alias("h2"), F.col("cell").alias("own"), F.explode(F.concat(F.array("cell"), F.expr(up))).alias("ask"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= MAX_BITS
    once = (F.col("ask") != F.col("own")) | (F.col("fp") < F.col("fp2"))
    return home.join(asks, (F.col("cell") == F.col("ask")) & (F.col("half") == F.col("h2")) & (F.col("root") != F.col("root2")) & near & once)


def links(classes: DataFrame) -> DataFrame:
    """Pairs (u, v), u > v, of roots that have members whose fingerprints differ in 1 to MAX_BITS
    bits. `classes`: fp, unique, and root; members of one root are not paired."""
    return _meetings(classes).select(F.greatest("root", "root2").alias("u"), F.least("root", "root2").alias("v")).distinct()


def with_least(pairs: DataFrame) -> DataFrame:
    """`pairs` (a, b) with m, the least of a and all its b."""
    low = pairs.groupBy("a").agg(F.min("b").alias("m")).select(moved("a", "m").alias("k"), F.least("a", "m").alias("m"))
    return pairs.join(low, F.col("a") == F.col("k"))


def stars(u: list[int], v: list[int]) -> tuple[list[int], list[int]]:
    """Every node of the edges but the roots, and its root: the smallest node it can reach."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in zip(u, v):
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    nodes = [x for x in up if top(x) != x]
    return nodes, [top(x) for x in nodes]


def _solved(edges: DataFrame) -> DataFrame:
    """The stars (u, v) of a small graph's components, by one task."""

    def run(batches):
        u, v = [], []
        for b in batches:
            u += b.column(0).to_pylist()
            v += b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(u, v)], names=["u", "v"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u > v): root is the smallest node it can reach.

    Large and small stars in turn (Kiveris et al., 2014), each written out, until nothing changes.
    No step gathers a neighbourhood: minima are partial aggregates, the rest are joins, which
    are split at a node that has a large part of all edges. What has SMALL_GRAPH edges or fewer,
    at first or after some rounds, is solved in one task: its rounds would be
    many jobs, whose tasks cost the driver far more than the edges cost anyone.
    """

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = materialize(edges, "edges")
    seen = state(now)
    while seen[0]:
        if seen[0] <= SMALL_GRAPH:
            before, now = now, materialize(_solved(now), "small")
            discard(before)
            break
        both = now.select(F.col("u").alias("a"), F.col("v").alias("b")).union(now.select(F.col("v").alias("a"), F.col("u").alias("b")))
        large = materialize(with_least(both).where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct(), "large")
        discard(now)
        small = with_least(large.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("m").alias("v")), F.struct(F.col("b").alias("u"), F.col("m").alias("v")))).alias("e"))
        now, before = materialize(small.select("e.u", "e.v").where("u != v").distinct(), "small"), seen
        discard(large)
        seen = state(now)
        if seen == before:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out.scratch = now.scratch
    return out


def _hubs_rooted(classes: DataFrame, hubs: DataFrame) -> DataFrame:
    """`classes` with root, the same for all that the links `hubs` connect."""
    first = components(hubs)
    return materialize(classes.join(first.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "near")


def near_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (u, v), u > v, of fingerprints within MAX_BITS, enough to connect all that are: those with
    the hubs of their cells, then one for any two roots that these leave apart. `classes`: fp, unique."""
    hubs = materialize(hub_links(classes), "hubs")
    met = _meetings(_hubs_rooted(classes.select("fp"), hubs))
    pair = F.struct(F.greatest("fp", "fp2").alias("u"), F.least("fp", "fp2").alias("v"))
    return hubs.union(met.groupBy(F.greatest("root", "root2"), F.least("root", "root2")).agg(F.min(pair).alias("pair")).select("pair.u", "pair.v"))


def rooted(classes: DataFrame) -> DataFrame:
    """`classes` (fp, unique, and more) with root, the same for all that links connect.

    Hubs of each cell come first; then only classes of different roots are paired, so a dense
    family gives about three links a member and not all of its pairs.
    """
    near = _hubs_rooted(classes, hub_links(classes))
    second = components(links(near)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return near.join(second, "root", "left").select(*classes.columns, F.coalesce("top", "root").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row.

    Null and empty texts have fingerprint zero and link like any other. Texts are taken whole,
    however long. Rows that repeat a doc_id, or whole rows, are judged each; a null doc_id takes
    part, but cannot be a component's id, so a component of null ids alone has a null one. Ties
    cannot arise: ids alone decide. An empty table gives no rows. Other columns, whatever their
    names, are not read.
    """
    small_batches(docs.sparkSession)
    with scratch_scope() as scope:
        own = materialize(fingerprints(docs), "fingerprints")
        # A class without any id still links others; its root is a fingerprint.
        classes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
        tops = materialize(rooted(classes), "tops")
        # Components are found between fingerprints; the smallest id of each is a partial aggregate.
        ids = tops.groupBy("root").agg(F.min("first").alias("component_id"), F.min("fp").alias("some")).select(moved("root", "some").alias("root"), "component_id")
        named = tops.select("fp", "root").join(ids, "root").select("fp", "component_id")
        out = own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
        return scope.keep(materialize(out, "components"))


def deduplicate(docs: DataFrame, find: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """One row of each component, all columns of `docs`: that with the smallest doc_id.

    `find` names the component of each row: doc_id and component_id, for unique ids.

    Null texts are copies of each other. Where ids repeat or are null, rows are told apart by
    keys of their own, so that unlike rows under one id all stay; a null id counts as the
    largest, and of equal ids in a component any one row stays. An empty table gives none.
    Columns of `docs` may have any names.
    """
    if unique_ids(docs):
        found = find(docs)
        # A name that is longer than any of `docs` is none of them.
        name = "_" * (1 + max(map(len, docs.columns)))
        stay = found.where("doc_id = component_id").select(F.col("doc_id").alias(name))
        return docs.join(stay, F.col("doc_id").cast("long") == F.col(name), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("the_row")
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("id"), row), "keyed")
    found = find(rows.select(F.col("key").alias("doc_id"), F.col("the_row.text").alias("text")))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    first = found.withColumnRenamed("doc_id", "key").join(rows.select("key", "id"), "key").groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select("first.key"), "key", "left_semi").select("the_row.*")
