"""Near copies by SimHash and, exactly, the Jaccard similarity of their five-word shingles.

Fingerprints of the shingles meet in SimHash's grid (`simhash.near_pairs`), and texts that it brings
together are compared. Texts can be similar and yet differ in more bits than any grid
reaches, so what that leaves apart is then looked for by an exact way, and no link is lost.

Two sets with a similarity of 4/5 or more share an element among the first n - ceil(4n/5) + 1
of each, in any order common to all sets (prefix filter). The order is by hash, after which
come the shingles that a sample of the texts shows to be common, so that those meet rarely.
The sample decides only the cost: the result is the same for any order.

Of the sets that meet, most unlike ones are told by bitmaps: each has the parity of its shingles
by 512 buckets, and two bitmaps differ in no more bits than their sets in elements, which is at
most a ninth of their sizes' sum at 4/5. Of long sets the number of shingles in each bucket is
compared too, which tells more. The rest are compared shingle by shingle. To keep large groups from meeting in all
their pairs, each first meets three members of its cell only; components are formed, and then
only pairs whose components still differ are compared.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, moved, partitions, read_buckets, scratch_path, scratch_scope, sliced, small_batches, text_or_empty, write_buckets
from .simhash import components, majority, near_pairs
from .tokens import release

WORDS = 5
SEED = 42
#: Similar are sets whose similarity is at least this fraction.
SHARE, OF = 4, 5
#: One text in so many is looked at for common shingles, and this many of those are kept.
SAMPLE, COMMON = 32, 30_000
#: Words of 64 bits in a bitmap.
BITMAP = 8
#: Sets of more shingles have most bits at random; of them counts by bucket are compared as well.
LONG = 900
#: A text of more pairs than this is kept once more for each further so many, so that no task gets all of them.
PAIRS_A_COPY = 256
#: So many ids may be sent to every executor, some 16 MB, to choose rows or name their roots without moving all.
BROADCAST_NODES = 1 << 20
#: Another order of nodes, for a third member to meet.
TURN = 0x2545F4914F6CDD1D


def sent(nodes: DataFrame) -> DataFrame:
    """`nodes`, one or two numbers a row and written out, to every executor if their number permits; else they are joined like any table."""
    return F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes


def lowered(text: str) -> list[bytes]:
    return text.lower().encode().split()


def shingles(text: str) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles, ascending; a shorter text is one shingle."""
    words = lowered(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(size) - size
    ends = (start + size - 1)[min(WORDS, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start.tolist(), ends)), np.uint64, len(ends)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if OF * min(len(a), len(b)) < SHARE * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= SHARE * (len(a) + len(b) - both)


def prefix(h: np.ndarray, common: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The first shingles of the set `h`, of which any similar set has one among its own."""
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        h = h[np.lexsort((h, np.where(common[at] == h, seen[at], 0)))]
    return h[: len(h) - -(-SHARE * len(h) // OF) + 1]


def bitmap(h: np.ndarray) -> np.ndarray:
    """Parity of the set's shingles in each bucket, packed in signed words."""
    odd = np.bincount((h % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def counts(h: np.ndarray) -> bytes:
    """Number of the set's shingles in each bucket, one byte each."""
    return np.minimum(np.bincount((h % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP), 255).astype(np.uint8).tobytes()


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id and digest of its lower-cased words."""

    def run(batches):
        release()
        for b in sliced(batches, 512):
            made = [xxhash.xxh3_128_digest(b" ".join(lowered(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["doc_id", "digest"])

    return docs.mapInArrow(run, "doc_id long, digest binary")


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sampled texts have, ascending, and how many have each."""

    def run(batches):
        for b in sliced(batches, 512):
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t).view(np.int64))], names=["shingle"])

    sample = docs.where(f"pmod(xxhash64(text), {SAMPLE}) = 0").select("text").distinct().mapInArrow(run, "shingle long")
    top = sample.groupBy("shingle").count().where("count > 1").orderBy(F.desc("count"), "shingle").limit(COMMON).collect()
    found = np.array([r[0] for r in top], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.array([r[1] for r in top], np.int64)[order]


def _prefixes(texts: DataFrame, common: np.ndarray, seen: np.ndarray) -> DataFrame:
    """shingle, node of each text's prefix, and for each text one row without shingle that has n (size of its set), the bitmap's words, of long sets the counts, and the fingerprint."""
    words = [f"w{k}" for k in range(BITMAP)]

    def run(batches):
        release()
        for part in sliced(batches, 256):
            nodes, sets = part.column(0).to_numpy(), [shingles(t) for t in part.column(1).to_pylist()]
            firsts = [prefix(h, common, seen) for h in sets]
            found = np.concatenate(firsts).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(np.repeat(nodes, [len(x) for x in firsts])), pa.nulls(len(found), pa.int32()), *[pa.nulls(len(found), pa.int64())] * BITMAP, pa.nulls(len(found), pa.binary()), pa.nulls(len(found), pa.int64())],
                names=["shingle", "node", "n", *words, "counts", "fp"],
            )
            maps, marks = np.array([bitmap(h) for h in sets]), np.array([majority(h) for h in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(sets), pa.int64()), pa.array(nodes), pa.array([len(h) for h in sets], pa.int32()), *[pa.array(np.ascontiguousarray(maps[:, k])) for k in range(BITMAP)], pa.array([counts(h) if len(h) > LONG else None for h in sets], pa.binary()), pa.array(marks)],
                names=["shingle", "node", "n", *words, "counts", "fp"],
            )

    return texts.mapInArrow(run, "shingle long, node long, n int" + "".join(f", {w} long" for w in words) + ", counts binary, fp long")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose texts are similar."""
    spark = docs.sparkSession

    def run(batches):
        known = lru_cache(maxsize=256)(shingles)
        for b in sliced(batches, 64):
            u, v, a, c = (x.to_pylist() for x in b.columns)
            yes = [similar(known(s), known(t)) for s, t in zip(a, c)]
            yield b.select(["u", "v"]).filter(pa.array(yes, pa.bool_()))

    # Only texts of some pair are moved, once, into buckets; then one text moves with each pair. Those
    # of many pairs, such as a large group's hubs, lie in several buckets, each for a share of their pairs.
    counted = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_COPY).cast("int").alias("copies"))
    some = materialize(counted, "some")
    folder, buckets = scratch_path(spark, "compared"), partitions(spark)
    texts = docs.join(sent(some), F.col("doc_id") == F.col("node")).select("node", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "text")
    write_buckets(texts.repartition(buckets, "node", "copy").sortWithinPartitions("node", "copy"), folder, buckets, "node", "copy")
    spread = sent(some.where("copies > 1"))
    for k, other in (("u", "v"), ("v", "u")):
        pairs = pairs.join(spread.select(F.col("node").alias(k), F.col("copies").alias(f"of_{k}")), k, "left")
        pairs = pairs.withColumn(f"of_{k}", F.pmod(F.xxhash64(other), F.coalesce(f"of_{k}", F.lit(1))).cast("int"))
    one, two = (read_buckets(spark, folder, "node BIGINT, copy INT, text STRING", buckets, "node", "copy") for _ in range(2))
    met = pairs.join(one.hint("merge"), (F.col("u") == F.col("node")) & (F.col("of_u") == F.col("copy"))).select("u", "v", "of_v", F.col("text").alias("a"))
    met = met.join(two.hint("merge"), (F.col("v") == F.col("node")) & (F.col("of_v") == F.col("copy")))
    return met.select("u", "v", "a", "text").mapInArrow(run, "u long, v long")


def _alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose counts by bucket, where both are long, do not differ by more than similar sets' can."""

    def run(batches):
        for b in sliced(batches, 4096):
            a, c = (b.column(k).to_pylist() for k in (2, 3))
            yes = np.ones(b.num_rows, bool)
            both = [k for k in range(b.num_rows) if a[k] and c[k]]
            if both:
                x, y = (np.frombuffer(b"".join([v[k] for k in both]), np.uint8).reshape(len(both), -1).astype(np.int16) for v in (a, c))
                n = np.array([b.column(4)[k].as_py() for k in both])
                yes[both] = (OF + SHARE) * np.abs(x - y).sum(axis=1) <= (OF - SHARE) * n
            yield b.select(["u", "v"]).filter(pa.array(yes))

    one, two = (sketches.select(F.col("node").alias(k), F.col("counts").alias(c), F.col("n").alias(m)) for k, c, m in (("u", "a", "m"), ("v", "c", "n")))
    met = pairs.join(one, "u", "left").join(two, "v", "left").select("u", "v", "a", "c", (F.col("m") + F.col("n")).alias("size"))
    return met.mapInArrow(run, "u long, v long")


def _possible(one: str, two: str) -> Column:
    """Whether sets of these sizes and bitmaps (structs `one` and `two`) can be similar."""
    size = f"{OF} * least({one}.n, {two}.n) >= {SHARE} * greatest({one}.n, {two}.n)"
    differ = " + ".join(f"bit_count({one}.w{k} ^ {two}.w{k})" for k in range(BITMAP))
    # A similarity of s/o leaves a symmetric difference of at most (o - s) / (o + s) of the sizes' sum.
    return F.expr(f"{size} AND {OF + SHARE} * ({differ}) <= {OF - SHARE} * ({one}.n + {two}.n)")


def _simhash_pairs(marks: DataFrame) -> DataFrame:
    """Pairs (u, v), u > v, of texts whose fingerprints are equal or meet in SimHash's grid. Each text is paired
    with the first of its fingerprint, and firsts with each other. `marks`: node, unique, and fp."""
    classes = materialize(marks.groupBy("fp").agg(F.min("node").alias("first")), "marks")
    one, two = (classes.select(F.col("fp").alias(k), F.col("first").alias(a)) for k, a in (("u", "a"), ("v", "b")))
    ends = near_pairs(classes).join(one, "u").join(two, "v").select("a", "b")
    same = marks.join(classes, "fp").where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return ends.union(same).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def _apart(pairs: DataFrame, star: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose roots in `star` differ."""
    roots = sent(star)
    for k in ("u", "v"):
        pairs = pairs.join(roots.select(F.col("node").alias(k), F.col("root").alias(f"of_{k}")), k, "left")
    return pairs.where(F.coalesce("of_u", "u") != F.coalesce("of_v", "v")).select("u", "v")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable over similar texts) of every row.

    `docs` has unique doc_id without nulls. Texts of equal lower-cased words are one node;
    null counts as empty, and empty texts are copies of each other. Texts are taken whole, however
    long. Only hashes of shingles are compared, 64 bits each. An empty table gives no rows.
    Other columns, whatever their names, are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    small_batches(docs.sparkSession)
    with scratch_scope() as scope:
        own = materialize(_classes(docs), "digests")
        least = materialize(own.groupBy("digest").agg(F.min("doc_id").alias("node")), "nodes")
        texts = docs.join(sent(least.select("node")), F.col("doc_id") == F.col("node"), "left_semi").select(F.col("doc_id").alias("node"), "text")
        prefixes = materialize(_prefixes(texts, *_common(docs)), "prefixes")
        sketches = prefixes.where("counts IS NOT NULL").select("node", "n", "counts")
        sets = prefixes.where("shingle IS NULL").select("node", F.struct("n", *[f"w{k}" for k in range(BITMAP)]).alias("set"))

        def compared(pairs: DataFrame, name: str) -> DataFrame:
            near = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("one")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("two")), "v")
            return _verified(materialize(_alike(near.where(_possible("one", "two")).select("u", "v"), sketches), name), docs)

        star = components(compared(_simhash_pairs(prefixes.where("shingle IS NULL").select("node", "fp")), "near"))
        # From here on the exact way, for texts that SimHash leaves apart.
        listed = prefixes.where("shingle IS NOT NULL").select("shingle", "node")
        turned = F.col("node").bitwiseXOR(F.lit(TURN))
        cells = listed.join(sent(star), "node", "left").withColumn("root", F.coalesce("root", "node"))
        cells = cells.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("m0"), F.max("node").alias("m1"), F.min(turned).bitwiseXOR(F.lit(TURN)).alias("m2"))
        cells = cells.where("low != high").select(moved("shingle", "m0").alias("shingle"), "m0", "m1", "m2")
        met = materialize(listed.join(cells, "shingle"), "met")
        # A few members of each cell are met by all others.
        few = met.select("node", F.explode(F.array("m0", "m1", "m2")).alias("hub")).where("node != hub")
        few = few.select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()
        star = components(star.select(F.col("node").alias("u"), F.col("root").alias("v")).union(compared(_apart(few, star), "few")))
        # What those leave apart is compared pair by pair.
        rooted = materialize(met.select("shingle", "node").join(sent(star), "node", "left").select("shingle", "node", F.coalesce("root", "node").alias("root")), "rooted")
        discard(met)
        mixed = rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select(moved("shingle", "low").alias("shingle"))
        left = materialize(rooted.join(mixed, "shingle", "left_semi").join(sets, "node").select("shingle", F.col("node").alias("u"), "root", F.col("set").alias("one")), "mixed")
        discard(rooted)
        right = left.select("shingle", F.col("u").alias("v"), F.col("root").alias("root2"), F.col("one").alias("two"))
        rest = left.join(right, "shingle").where((F.col("u") > F.col("v")) & (F.col("root") != F.col("root2")) & _possible("one", "two"))
        rest = materialize(_alike(rest.select("u", "v").distinct(), sketches), "rest")
        discard(left, prefixes)
        star = components(star.select(F.col("node").alias("u"), F.col("root").alias("v")).union(_verified(rest, docs)))
        named = least.join(star, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
        return scope.keep(materialize(own.join(named, "digest").select("doc_id", "component_id"), "components"))
