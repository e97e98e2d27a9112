"""Token counts as rollups kept up by signed deltas.

A batch of inserts (+), deletes (-) and revisions (new minus old) is summed by source,
language and tokenizer version and committed under its own name. A name that is committed
already is skipped, so a replayed batch changes nothing. Totals are sums over a compacted
base and the batches since; compaction deletes what it has taken in.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remove, small_batches
from .tokens import encoder

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

#: Pieces that a worker's encoders keep in all. Two texts of each row are held here besides, so fewer than elsewhere.
CACHE_PIECES = 400_000

#: Counts without a tokenizer file.
WORDS = "words@1"


def count_tokens(docs: DataFrame, columns: dict[str, str], tokenizers: dict[str, str]) -> DataFrame:
    """the_row (all columns of `docs` but the texts) and, for each text column in `columns`, a column
    named by its value: an array of its counts by version (see `versions`).

    Null text counts as empty; texts are encoded whole, however long. Rows that repeat are counted
    each, and an empty table gives no rows. Columns of `docs` cannot clash with the counts: they
    travel inside the_row.
    """
    small_batches(docs.sparkSession)
    texts = list(columns)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in texts]).alias("the_row")
    rows = docs.select(row, *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(f"t{k}") for k, c in enumerate(texts)])
    schema = rows.select("the_row").schema
    for name in columns.values():
        schema = schema.add(name, T.ArrayType(T.LongType()))
    kind = pa.list_(pa.int64())

    def run(batches):
        encoders = [encoder(path, CACHE_PIECES // len(tokenizers)) for path in tokenizers.values()]
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                made, known = [], None
                for k in range(len(texts)):
                    values = part.column(1 + k).to_pylist()
                    # A second text that equals the first is not encoded again.
                    todo = values if known is None else [v for v, w in zip(values, known) if v != w]
                    counts = list(zip(*([len(x.split()) for x in map(str.encode, todo)], *([len(i) for i in e.ids(todo)] for e in encoders))))
                    if known is not None:
                        fresh = iter(counts)
                        counts = [next(fresh) if v != w else r for v, w, r in zip(values, known, first)]
                    else:
                        known, first = values, counts
                    made.append(pa.array(counts, kind))
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["the_row", *columns.values()])

    return rows.mapInArrow(run, schema)


def versions(tokenizers: dict[str, str]) -> list[str]:
    return [WORDS, *tokenizers]


def deltas(counted: DataFrame, names: list[str], new: str | None = None, old: str | None = None, source: str = "the_row.source", lang: str = "the_row.lang", new_source: str | None = None, new_lang: str | None = None) -> DataFrame:
    """Signed rows for documents whose counts are in the columns `new` and `old`.

    Inserts have `new` alone, deletes `old` alone. Revisions have both, and are taken from the
    group in `source` and `lang` and added to that in `new_source` and `new_lang`, or to the same.
    """

    def side(counts: str, sign: int, s: str, g: str) -> list[Column]:
        return [F.struct(F.col(s).alias("source"), F.col(g).alias("lang"), F.lit(n).alias("tokenizer"), F.lit(sign).cast("long").alias("n_docs"), (sign * F.col(counts)[k]).cast("long").alias("n_tokens")) for k, n in enumerate(names)]

    rows = (side(new, 1, new_source or source, new_lang or lang) if new else []) + (side(old, -1, source, lang) if old else [])
    return counted.select(F.explode(F.array(*rows)).alias("d")).select("d.*")


class Ledger:
    """Rollups in a folder that every executor can reach; one writer at a time.

    Batches are folders under batch/. A base is the sum of all before it; the names it has taken in
    are beside it, in names/ and of the same number, and count only once the base is committed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _done(self, path: str) -> bool:
        """Whether the folder has Spark's commit marker; one without it is of a write that broke off."""
        fs, p = self._fs(f"{self.path}/{path}/_SUCCESS")
        return fs.exists(p)

    def _names(self, kind: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{kind}")
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _base(self) -> str | None:
        """The newest base; older ones are deleted by the compaction that made it."""
        return max((b for b in self._names("base") if self._done(f"base/{b}")), default=None)

    def _merged(self, asked: list[str]) -> set[str]:
        """Those of the names asked for that bases have taken in; the others are not read to the driver."""
        base = self._base()
        lists = [f"{self.path}/names/{n}" for n in self._names("names") if base is not None and n <= base]
        if not lists or not asked:
            return set()
        return {r.batch for r in self.spark.read.schema("batch string").parquet(*lists).where(F.col("batch").isin(asked)).collect()}

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit one batch; False if its name is committed already. Hot groups are summed before the exchange.

        Null keys are groups of their own. Repeated rows each count. An empty batch is committed as such."""
        if not batch or "/" in batch or batch[0] in "._":
            raise ValueError("a batch needs a name that can be a folder's")
        if self._done(f"batch/{batch}") or self._merged([batch]):
            return False
        rolled = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        rolled.write.mode("overwrite").parquet(f"{self.path}/batch/{batch}")
        return True

    def _sum(self, paths: list[str]) -> DataFrame:
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 OR n_tokens != 0")

    def _open(self) -> list[str]:
        """Batches since the base: those that a compaction has taken in and not yet deleted are left out."""
        there = [b for b in self._names("batch") if self._done(f"batch/{b}")]
        merged = self._merged(there)
        return [b for b in there if b not in merged]

    def totals(self) -> DataFrame:
        """Groups whose sums are not both zero. An empty ledger gives no rows."""
        base = self._base()
        return self._sum([f"{self.path}/base/{base}"] * (base is not None) + [f"{self.path}/batch/{b}" for b in self._open()])

    def compact(self) -> None:
        """Fold all batches into a new base, and delete them and the old base.

        Their names are written first, the base is committed next and deletion comes last, so a
        break at any point leaves the old state or the new one in force."""
        base, taken = self._base(), self._open()
        following = f"{int(base) + 1 if base is not None else 0:012d}"
        totals = self.totals()
        self.spark.createDataFrame([(n,) for n in taken], "batch string").write.mode("overwrite").parquet(f"{self.path}/names/{following}")
        totals.write.mode("overwrite").parquet(f"{self.path}/base/{following}")
        merged = self._merged(self._names("batch"))
        for path in [f"base/{b}" for b in self._names("base") if b < following] + [f"batch/{b}" for b in sorted(merged)]:
            remove(self.spark, f"{self.path}/{path}")
