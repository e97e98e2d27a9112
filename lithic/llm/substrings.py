"""Repeated passages through a log-structured index of window fingerprints.

Every window of 35 words is represented by its anchor: the twelve-word gram of smallest hash
in it. Equal windows have equal anchors, and about one position in twelve is an anchor,
so only these are indexed: fingerprint of the gram, hash of the anchor's span (all windows
that it stands for), number of occurrences, and one place.

The index is a folder of immutable runs, stored in buckets of (fingerprint, span) and sorted
by it, and a log of manifests that says which runs hold. A batch's run is merge-joined with
the runs of the history, in which only the batch moves; it is committed by the next manifest,
and as many runs of one level as the fan-out are merged to one of the next level. Afterwards

* a span that occurs twice is repeated as a whole, wherever it occurs;
* where one gram has several different spans, their windows are compared one by one.

Both comparisons are first made on 64-bit hashes. What they find is then verified on the words.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, partitions, read_buckets, remove, scratch_path, scratch_scope, small_batches, sorted_buckets, text_or_empty, unique_ids, write_buckets

WINDOW = 35
#: Words of an anchor. Shorter ones recur by chance in unlike passages, whose windows then must be compared.
GRAM = 12
_SPAN = WINDOW - GRAM + 1  # grams in a window; an anchor stands for at most as many windows

_GRAM_BASE = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were ever needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            size = 1 << max(12, n.bit_length())
            run = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
            cls.up, cls.down = run(_BASE), run(_INVERSE)


class Anchored:
    """The anchors of one text's words."""

    def __init__(self, words: list[bytes], bits: int = 64):
        n = self.n = len(words)
        self.bits = np.uint64((1 << bits) - 1)
        self.windows = max(0, n - WINDOW + 1)
        if not self.windows:
            self.first = self.last = np.empty(0, np.int64)
            self.fp = self.span = np.empty(0, np.int64)
            return
        seen: dict = {}
        number = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))[number]
        _Powers.reach(n + 1)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _Powers.up[:n])])
        g, base = h[: n - GRAM + 1].copy(), 1
        for k in range(1, GRAM):
            base = base * _GRAM_BASE % (1 << 64)
            g += h[k : n - GRAM + 1 + k] * np.uint64(base)
        g ^= g >> np.uint64(31)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(29)
        at = np.lib.stride_tricks.sliding_window_view(g, _SPAN).argmin(axis=1) + np.arange(self.windows)
        self.first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])  # first and last window of each anchor
        self.last = np.concatenate([self.first[1:] - 1, [self.windows - 1]])
        self.fp = g[at[self.first]].view(np.int64)
        self.span = self.hashes(self.first, self.last + WINDOW)

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of word ranges, the same wherever the words stand."""
        x = (self.prefix[end] - self.prefix[begin]) * _Powers.down[begin] + (end - begin).astype(np.uint64)
        return (x & self.bits).view(np.int64)

    def window_hashes(self, at: int) -> np.ndarray:
        """Hashes of the windows of the anchor whose first window begins at word `at`."""
        k = np.searchsorted(self.first, at)
        begin = np.arange(at, self.last[k] + 1)
        return self.hashes(begin, begin + WINDOW)


#: A mark for all windows of an anchor; it has one bit more than there are windows, which tells it from a mask of each of them.
ALL = (1 << _SPAN + 1) - 1


def covered(n: int, marks: list) -> np.ndarray:
    """Which of `n` words lie in marked windows; a mark has an anchor's first window, the number of its windows and a bit for each."""
    edge = np.zeros(n + 1, np.int64)
    for m in marks:
        at, size, mask = m["at"], m["size"], m["mask"]
        if mask == ALL:
            edge[at] += 1
            edge[at + size + WINDOW - 1] -= 1
        else:
            begin = at + np.flatnonzero(mask >> np.arange(size) & 1)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + WINDOW, -1)
    return np.cumsum(edge)[:-1] > 0


def anchor_table(docs: DataFrame, bits: int = 64) -> DataFrame:
    """key, n_words, sha256 of all words, and the anchors in order: fingerprint, hash of the span, first window, number of windows."""
    anchor = pa.struct([("fp", pa.int64()), ("span", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                keys, texts = (c for c in b.slice(at, 512).columns)
                counts, shas, sizes, parts = [], [], [0], []
                for t in texts.to_pylist():
                    words = t.encode().split()
                    a = Anchored(words, bits)
                    counts.append(a.n)
                    shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    sizes.append(sizes[-1] + len(a.fp))
                    parts.append((a.fp, a.span, a.first, a.last - a.first + 1))
                rows = pa.StructArray.from_arrays([pa.array(np.concatenate(x), f.type) for x, f in zip(zip(*parts), anchor)], fields=list(anchor))
                yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows)], names=["key", "n_words", "sha", "anchors"])

    return docs.select("key", text_or_empty().alias("text")).mapInArrow(run, "key long, n_words long, sha string, anchors array<struct<fp: long, span: long, at: int, size: int>>")


def places(anchors: DataFrame) -> DataFrame:
    return anchors.select("key", F.explode("anchors").alias("a")).select("a.fp", "a.span", "key", "a.at", "a.size")


@dataclass(frozen=True)
class Run:
    """Occurrences in the batches from `low` to `high`, both included."""

    name: str
    level: int
    low: int
    high: int


class RunIndex:
    """Runs of (fp, span, n, key, at) under a folder that all executors share.

    The state is in the folder: any session that opens it sees what was committed. Batches are
    numbered from 0. One writer at a time: of two that commit the same version one fails.
    A run that no manifest names (its writer broke off) is not part of the index and is deleted
    by a later commit. A row is rewritten at most once for each level, so at most log(batches)
    to the base `fanout` times in all.
    """

    COLUMNS = "fp BIGINT, span BIGINT, n BIGINT, key BIGINT, at INT"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fanout: int = 4):
        """Open the index at `path`, or begin one; `buckets` and `fanout` hold for a new one only."""
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        self.fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())
        version, found = self._newest()
        if found is None:
            found = {"buckets": buckets or partitions(spark), "fanout": fanout, "next": 0, "runs": []}
            self._put(version + 1, found)
        self._take(found)

    # --- the log of manifests

    def _versions(self) -> list[int]:
        folder = self._at("manifest")
        return sorted(int(x.getPath().getName()) for x in self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def _newest(self) -> tuple[int, dict | None]:
        """The newest version of all, and the newest manifest that is whole: one that broke off has no end mark."""
        versions = self._versions()
        for v in reversed(versions):
            stream = self.fs.open(self._at("manifest", f"{v:012d}"))
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if text.endswith("\n"):
                return versions[-1], json.loads(text)
        return (versions[-1] if versions else 0), None

    def _put(self, version: int, state: dict) -> None:
        """Creating the file fails if another writer has made it."""
        out = self.fs.create(self._at("manifest", f"{version:012d}"), False)
        out.write(bytearray(json.dumps(state).encode() + b"\n"))
        out.close()

    def _take(self, state: dict) -> None:
        self.buckets, self.fanout, self.next = state["buckets"], state["fanout"], state["next"]
        self.runs = [Run(**r) for r in state["runs"]]

    def _commit(self, runs: list[Run], following: int) -> None:
        version, now = self._newest()
        if now["next"] != self.next or [Run(**r) for r in now["runs"]] != self.runs:
            raise RuntimeError("the index was changed by another writer")
        state = {"buckets": self.buckets, "fanout": self.fanout, "next": following, "runs": [r.__dict__ for r in runs]}
        self._put(version + 1, state)
        self._take(state)
        self.vacuum()

    def vacuum(self) -> None:
        """Delete runs that the newest manifest does not name, and manifests before it."""
        kept = {r.name for r in self.runs}
        for x in self.fs.listStatus(self._at("runs")) if self.fs.exists(self._at("runs")) else []:
            if x.getPath().getName() not in kept:
                self.fs.delete(x.getPath(), True)
        for v in self._versions()[:-1]:
            self.fs.delete(self._at("manifest", f"{v:012d}"), False)

    # --- runs

    def read(self, run: Run) -> DataFrame:
        return read_buckets(self.spark, f"{self.path}/runs/{run.name}", self.COLUMNS, self.buckets, "fp", "span")

    def _write(self, df: DataFrame, run: Run) -> Run:
        with sorted_buckets(self.spark):
            write_buckets(df, f"{self.path}/runs/{run.name}", self.buckets, "fp", "span")
        return run

    def ingest(self, batch: int, found: DataFrame) -> Run | None:
        """Write the run of batch number `batch` (`found`: fp, span, key, at); None if it is committed already.

        Occurrences are summed before the exchange, so a hot key is one row of each task."""
        if batch < self.next:
            return None
        if batch > self.next:
            raise ValueError(f"the next batch is {self.next}")
        own = found.groupBy("fp", "span").agg(F.count(F.lit(1)).alias("n"), F.first("key").alias("key"), F.first("at").alias("at"))
        own = own.repartition(self.buckets, "fp", "span").sortWithinPartitions("fp", "span")
        return self._write(own, Run(f"run-{uuid.uuid4().hex}", 0, batch, batch))

    def matches(self, run: Run) -> DataFrame:
        """Rows of a run whose spans the history holds as well, with n0, key0, at0 of each run of it that does."""
        new = self.read(run)
        out = None
        for old in self.runs:
            there = self.read(old).select("fp", "span", F.col("n").alias("n0"), F.col("key").alias("key0"), F.col("at").alias("at0"))
            met = new.join(there.hint("merge"), ["fp", "span"])
            out = met if out is None else out.unionByName(met)
        none = [F.lit(None).cast(t).alias(c) for c, t in (("n0", "long"), ("key0", "long"), ("at0", "int"))]
        with sorted_buckets(self.spark):
            return materialize(new.select("*", *none).where("false") if out is None else out, "matches")

    def commit(self, run: Run) -> None:
        """Make a batch's run part of the index, and merge runs of a full level."""
        self._commit([*self.runs, run], run.high + 1)
        while full := [r for r in self.runs if sum(r.level == q.level for q in self.runs) >= self.fanout]:
            full = [r for r in full if r.level == full[0].level]
            merged = self._write(self._merged(full), Run(f"run-{uuid.uuid4().hex}", full[0].level + 1, min(r.low for r in full), max(r.high for r in full)))
            self._commit([merged, *[r for r in self.runs if r not in full]], self.next)

    def _merged(self, runs: list[Run]) -> DataFrame:
        out = self.read(runs[0])
        for r in runs[1:]:
            old = self.read(r).select("fp", "span", F.col("n").alias("n0"), F.col("key").alias("key0"), F.col("at").alias("at0"))
            # A place is taken whole from one side.
            place = lambda c: F.when(F.col("key").isNull(), F.col(f"{c}0")).otherwise(F.col(c)).alias(c)
            out = out.join(old.hint("merge"), ["fp", "span"], "full_outer").select("fp", "span", (F.coalesce("n", F.lit(0)) + F.coalesce("n0", F.lit(0))).alias("n"), place("key"), place("at"))
        return out

    def rows(self) -> DataFrame:
        """Every span once, with all its occurrences."""
        return self._merged(self.runs) if self.runs else self.spark.createDataFrame([], self.COLUMNS)


def window_rows(texts: DataFrame, wanted: DataFrame, bits: int = 64) -> DataFrame:
    """(fp, window, n, key, at, place) for every window of the wanted anchors (fp, key, at, n)."""
    per_text = wanted.groupBy("key").agg(F.collect_list(F.struct("fp", "at", "n")).alias("wanted"))
    names = ["fp", "window", "n", "key", "at", "place"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out: list[list] = [[] for _ in names]
                for key, text, marks in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)):
                    a = Anchored(text.encode().split(), bits)
                    for m in marks:
                        w = a.window_hashes(m["at"])
                        for c, v in zip(out, (np.full(len(w), m["fp"]), w, np.full(len(w), m["n"]), np.full(len(w), key), np.full(len(w), m["at"]), np.arange(len(w)))):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, kinds)], names=names)

    rows = texts.join(per_text.hint("merge"), "key")
    return rows.select("key", "text", "wanted").mapInArrow(run, "fp long, window long, n long, key long, at int, place int")


def claimed_words(texts: DataFrame, claims: DataFrame) -> DataFrame:
    """(fp, hash, words) for each claim (key, fp, hash, at, length): `length` words from word `at` on."""
    per_text = claims.groupBy("key").agg(F.collect_list(F.struct("fp", "hash", "at", "length")).alias("claims"))
    names = ["fp", "hash", "words"]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                fps, hashes, found = [], [], []
                for text, marks in zip(*(c.to_pylist() for c in b.slice(at, 64).columns)):
                    words = text.encode().split()
                    for m in marks:
                        fps.append(m["fp"])
                        hashes.append(m["hash"])
                        found.append(b" ".join(words[m["at"] : m["at"] + m["length"]]))
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(hashes, pa.int64()), pa.array(found, pa.binary())], names=names)

    rows = texts.join(per_text.hint("merge"), "key")
    return rows.select("text", "claims").mapInArrow(run, "fp long, hash long, words binary")


def verified(texts: DataFrame, table: DataFrame, whole: DataFrame, again: DataFrame) -> DataFrame:
    """Marks (key, at, size, mask), on the words, for `whole` (fp, span, key, at, size) and `again` (fp, window, n, key, at, place).

    Under one hash there should be one sequence of words; equal ones are made one before the
    exchange. Grams with a hash that stands for unlike words, if there are any, have all of
    their windows compared word by word instead.
    """
    claims = whole.select("key", "fp", F.col("span").alias("hash"), "at", (F.col("size") + WINDOW - 1).alias("length"))
    single = again.select("key", "fp", F.col("window").alias("hash"), (F.col("at") + F.col("place")).alias("at"), F.lit(WINDOW).alias("length"))
    # One after the other, so that the words of one kind are gone before those of the other come.
    unlike = [materialize(claimed_words(texts, c).distinct().groupBy("fp", "hash").count().where("count > 1").select("fp").distinct(), "unlike") for c in (claims, single)]
    unlike = materialize(unlike[0].union(unlike[1]).distinct(), "unlike")
    part = again.where("n = 1").groupBy("key", "at").agg(F.expr("bit_or(shiftleft(1L, place))").alias("mask"), F.lit(_SPAN).alias("size"))
    marks = whole.select("key", "at", "size", F.lit(ALL).cast("long").alias("mask")).unionByName(part)
    if unlike.isEmpty():
        return marks
    doubted = materialize(places(table).join(unlike, "fp").select("key", "at", "size"), "doubted")
    every = doubted.select("key", F.explode(F.expr("sequence(at, at + size - 1)")).alias("at")).distinct()
    # Here the hash is the window's name.
    named = every.select("key", F.col("key").alias("fp"), F.col("at").cast("long").alias("hash"), "at", F.lit(WINDOW).alias("length"))
    each = materialize(claimed_words(texts, named), "each")
    same = materialize(each.groupBy("words").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("words"), "same")
    exact = each.join(same, "words").select(F.col("fp").alias("key"), F.col("hash").cast("int").alias("at"), F.lit(1).alias("size"), F.lit(1).cast("long").alias("mask"))
    return marks.join(doubted.select("key", "at"), ["key", "at"], "left_anti").unionByName(exact)


def find(docs: DataFrame, batches: int = 2, bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(anchor table, texts with repeats, marks) of `docs` (key, text): marks are key and a list of (at, size, mask)."""
    spark = docs.sparkSession
    table = materialize(anchor_table(docs, bits), "anchors")
    path = scratch_path(spark, "index")
    index = RunIndex(spark, path, fanout=2)
    met = []
    for k in range(batches):
        run = index.ingest(k, places(table.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == k)))
        # Repeated are spans that the history holds and those that the batch itself holds twice.
        met += [index.matches(run), materialize(index.read(run).where("n > 1"), "twice")]
        index.commit(run)
    whole = met[0].select("fp", "span")
    for m in met[1:]:
        whole = whole.union(m.select("fp", "span"))
    whole = materialize(whole.distinct(), "repeated")
    discard(*met)
    marks = materialize(places(table).join(whole, ["fp", "span"]).select("fp", "span", "key", "at", "size"), "whole")
    discard(whole)
    # Several spans around one gram: the place of each is in the index, and one stands for all equal ones.
    grams = materialize(index.rows().groupBy("fp").agg(F.count(F.lit(1)).alias("spans")).where("spans > 1").select("fp"), "grams")
    several = materialize(index.rows().join(grams, "fp").select("fp", "key", "at", "n"), "several")
    remove(spark, path)
    # From here on only texts with repeats are read, and they are not moved again.
    some = materialize(marks.select("key").union(several.select("key")).distinct(), "some")
    folder, buckets = scratch_path(spark, "texts"), partitions(spark)
    rows = docs.select("key", text_or_empty().alias("text")).join(some, "key", "left_semi").repartition(buckets, "key").sortWithinPartitions("key")
    write_buckets(rows, folder, buckets, "key")
    texts = read_buckets(spark, folder, "key BIGINT, text STRING", buckets, "key")
    windows = materialize(window_rows(texts, several, bits), "windows")
    twice = materialize(windows.groupBy("fp", "window").agg(F.sum("n").alias("total")).where("total > 1").select("fp", "window"), "twice")
    again = materialize(windows.join(twice, ["fp", "window"]), "again")
    discard(grams, several, windows, twice)
    sure = verified(texts, table, marks, again)
    listed = materialize(sure.groupBy("key").agg(F.collect_list(F.struct("at", "size", "mask")).alias("marks")), "marks")
    discard(marks, again, some)
    return table, texts, listed


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """`docs` as (key, text); where ids repeat or are missing, rows get keys of their own and a table of them."""
    if unique_ids(docs):
        return docs.select(F.col("doc_id").cast("long").alias("key"), "text"), None
    own = materialize(docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "keyed")
    return own.select("key", "text"), own.select("key", "doc_id")


RESULT = "key long, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, batches: int = 2, with_text: bool = False, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; `with_text` adds the kept words, joined by spaces.

    Null text has no words. A text of fewer than 35 words has no window and keeps all its
    words. Texts are taken whole, however long. Rows that repeat an id are texts of their own, and
    repeat each other's windows if the texts are equal; a null id stays null. Ties cannot arise:
    every occurrence of a repeated window goes. An empty table gives no rows. Other columns,
    whatever their names, are not read. `bits` below 64 make hashes collide, to test that words decide.
    """
    small_batches(docs.sparkSession)
    with scratch_scope() as scope, sorted_buckets(docs.sparkSession):
        return scope.keep(materialize(_removed(docs, batches, with_text, bits), "kept"))


def _removed(docs: DataFrame, batches: int, with_text: bool, bits: int) -> DataFrame:
    keyed, ids = _keyed(docs)
    table, repeating, marks = find(keyed, batches, bits)
    states = table.select("key", "n_words", "sha", F.size("anchors").alias("n_anchors")).join(marks, "key", "left")
    full = F.expr(f"marks IS NOT NULL AND size(filter(marks, m -> m.mask = {ALL})) = n_anchors")
    empty = hashlib.sha256(b"").hexdigest()
    names = ["key", "n_removed", "kept_sha256", *(["kept"] if with_text else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), *([pa.string()] if with_text else [])]

    def run(batches_):
        for b in batches_:
            for at in range(0, b.num_rows, 256):
                out = []
                for key, text, marked in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)):
                    words = text.encode().split()
                    gone = covered(len(words), marked or [])
                    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                    out.append((key, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode())[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), kinds)], names=names)

    texts = keyed.select("key", text_or_empty().alias("text"))
    if with_text:
        cut = texts.join(marks, "key", "left").mapInArrow(run, RESULT + ", kept string")
        out = table.select("key", "n_words").join(cut, "key")
    else:
        # Texts are moved only to where some but not all of their words go.
        partly = states.where(F.col("marks").isNotNull() & ~full).select("key", "marks")
        cut = repeating.join(partly.hint("merge"), "key").select("key", "text", "marks").mapInArrow(run, RESULT)
        out = states.withColumn("full", full).drop("marks").join(cut, "key", "left").select(
            "key", "n_words",
            F.coalesce("n_removed", F.when(F.col("full"), F.col("n_words")).otherwise(F.lit(0))).alias("n_removed"),
            F.coalesce("kept_sha256", F.when(F.col("full"), F.lit(empty)).otherwise(F.col("sha"))).alias("kept_sha256"),
        )
    if ids is not None:
        return out.join(ids, "key").drop("key").select("doc_id", *[c for c in out.columns if c != "key"])
    return out.withColumnRenamed("key", "doc_id")
