"""What several operators share: scratch tables in the shared folder, and the definition of a word."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII characters. `bytes.split()` and
#: `str.split` on this set agree, because no other UTF-8 byte is among them.
SPACE = r"\x20\x09-\x0D"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where none is named and all executors are
    threads of this process (tests), a temporary one, which is then set so that all of a session's
    jobs agree; on a cluster files in a local folder would be lost to the other executors."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="lithic-")
        atexit.register(shutil.rmtree, local, True)
        spark.conf.set("spark.checkpoint.dir", named := f"file://{local}")
    return named.rstrip("/")


class Scope:
    """Scratch folders that go when the scope ends, but for those that are kept."""

    def __init__(self) -> None:
        self.paths: dict[str, SparkSession] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Leave the files behind `df` to the scope around this one."""
        self.paths.pop(df.scratch, None)
        _scopes[max(0, _scopes.index(self) - 1)].paths[df.scratch] = df.sparkSession
        return df

    def close(self) -> None:
        for path, spark in self.paths.items():
            remove(spark, path)
        self.paths = {}


#: The outermost scope ends with the process: results that callers read lie there.
_scopes = [Scope()]


@atexit.register
def _last() -> None:
    # The session may have been stopped already, and its JVM with it.
    with contextlib.suppress(Exception):
        _scopes[0].close()


@contextlib.contextmanager
def scratch_scope() -> Iterator[Scope]:
    """Remove at the end what is materialized inside and not kept."""
    own = Scope()
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes.remove(own)
        own.close()


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/lithic/{name}-{uuid.uuid4().hex}"
    _scopes[-1].paths[path] = spark
    return path


#: Spark then deletes the shuffle files of an execution when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is executed inside is not executed again, so its shuffle files need not outlive it."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, a lost executor
    costs no more than the tasks it ran, and the shuffle files behind it are freed."""
    path = scratch_path(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch = path
    return back


def write_buckets(df: DataFrame, path: str, buckets: int, *by: str) -> None:
    """Write `df`, whose partitions should hold whole buckets, so that joins on `by` need not move it again."""
    name = f"lithic_{uuid.uuid4().hex}"
    with freed_shuffles(df.sparkSession):
        df.write.format("parquet").bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


def read_buckets(spark: SparkSession, path: str, schema: str, buckets: int, *by: str) -> DataFrame:
    """What write_buckets has written, by any session. Bucketing needs a table's name, but only until the files are found."""
    name = f"lithic_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({', '.join(by)}) SORTED BY ({', '.join(by)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


@contextlib.contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Plans made inside rely on the order in a bucket that is one file, so that it is not sorted again."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*frames: DataFrame) -> None:
    """Delete the files behind materialized frames that nothing will read again."""
    for df in frames:
        remove(df.sparkSession, df.scratch)
        for scope in _scopes:
            scope.paths.pop(df.scratch, None)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of an Arrow batch; several are held on either side of each Python worker.
BATCH_BYTES, _SETTING, _DEFAULT = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by size in this session, unless it has a bound of its own: ten thousand texts, Spark's
    bound by number, may be of any size. Results do not depend on it."""
    if spark.conf.get(_SETTING, _DEFAULT) == _DEFAULT:
        spark.conf.set(_SETTING, str(BATCH_BYTES))


def sliced(batches: Iterable, rows: int) -> Iterator:
    """Arrow batches of at most so many rows, so that few texts at a time are Python strings."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def moved(key: str, other: str) -> Column:
    """`key`, a long, written so that Spark does not know it for the key of the aggregate it comes from.

    A join right above an aggregate by the same key reuses its partitions, and those cannot be
    split where one key has most rows; with this both sides are exchanged for the join, and can be."""
    return F.expr(f"{key} ^ {other} ^ {other}")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unique_ids(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    ids = docs.groupBy("doc_id").count().agg(F.max("count").alias("most"), F.max(F.col("doc_id").isNull()).alias("none")).first()
    return not ids.none and (ids.most or 0) <= 1
