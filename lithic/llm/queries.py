"""The ten operators as registered queries, each over its whole table."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunking, htmltext, ledger, mixing, packing, pii, planes, quality, simhash, sql, substrings
from .common import load, materialize, scratch_path, scratch_scope


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The setting that holds the pseudonym key. Spark redacts settings of such a name wherever it shows them.
KEY_SETTING = "spark.lithic.pseudonymSecret"
_own_key: list[str] = []


def pseudonym_key(spark: SparkSession) -> str:
    """The key that the session sets. Where it sets none, a random one, which is kept nowhere but in
    this process: equal values are then linked within it only, and nobody can undo them later."""
    named = spark.conf.get(KEY_SETTING, None)
    if named is None and not _own_key:
        _own_key.append(secrets.token_hex(32))
    return _own_key[0] if named is None else named


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), packing.Packing(tokenizer_file("byte_bpe_50k.json")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, pseudonym_key(spark), count="n_found")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(load(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, load(spark, sf_dir, "labels")))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(load(spark, sf_dir, "pages"))


def op7_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch_scope() as scope:
        path = scratch_path(spark, "token-files")
        planes.write(load(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_id=2)
        return scope.keep(materialize(planes.read_documents(spark, path), "documents"))


def op8_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.compare_edited(load(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(load(spark, sf_dir, "documents"), carry=["doc_id"])
    return rows.select("the_row.doc_id", "source", "size", "block", "slot", "place")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: all are inserted; those labelled toxic are deleted; of
    those labelled bad that stay, the counts are revised to a text without the symbols #*$%&|<>.
    The first batch is then sent again, which changes nothing, and the ledger is compacted."""
    tokenizers = {"byte_bpe_50k@1": tokenizer_file("byte_bpe_50k.json")}
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.regexp_replace("text", "[#*$%&|<>]", "").alias("clean"))
    with scratch_scope() as scope:
        counted = materialize(ledger.count_tokens(docs, {"text": "old", "clean": "new"}, tokenizers), "counts")
        labels = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
        marked = counted.join(labels, F.col("the_row.doc_id") == F.col("doc_id"))
        names = ledger.versions(tokenizers)
        book = ledger.Ledger(spark, scratch_path(spark, "ledger"))
        inserts = ledger.deltas(counted, names, new="old")
        book.apply("insert-1", inserts)
        book.apply("delete-1", ledger.deltas(marked.where("toxic = 1"), names, old="old"))
        book.apply("revise-1", ledger.deltas(marked.where("toxic = 0 AND quality = 0"), names, new="new", old="old"))
        book.apply("insert-1", inserts)
        book.compact()
        return scope.keep(materialize(book.totals(), "totals"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_packing, op3_pii, op4_substrings, op5_quality, op6_html, op7_planes, op8_chunking, op9_mixing, op10_token_counts)}

#: The others are beyond SQL: they are tested against brute force, round trips and held-out rows.
ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL
