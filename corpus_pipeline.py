"""From raw documents to packed sequences: five stages, each written and read again by the next.

Every stage reads whole texts, however long, and defines null, empty and repeated input as its
docstring says. Columns beside doc_id, text and source may have any names and pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithic.llm import jaccard, mixing, packing, pii, quality, simhash
from lithic.llm.common import discard, load, materialize, scratch_scope
from lithic.llm.queries import pseudonym_key, tokenizer_file


#: Remainders packed together, of documents next to each other in the mixture.
GROUP = 256
#: Pieces that a worker's tokenizer keeps; workers hold it besides what other stages left in them.
CACHE_PIECES = 400_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; the model is fitted on the labelled rows among `docs`.

    Null and empty texts fail the base rule and go. Rows that repeat, or share an id, are judged
    each; a null id is no reason to go. Where labels of both classes are too few, the base rules
    alone decide. A probability equal to the threshold is enough. An empty table gives no rows.
    """
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep_columns=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): that with the smallest id.

    Null and empty texts are copies of each other. Unlike rows that share an id, or have none, all
    stay; of copies under one id any one stays, and a null id counts as the largest. An empty
    table gives no rows.
    """
    return simhash.deduplicate(docs, jaccard.near_copies)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, personal data replaced in their texts.

    Null text stays null and empty text empty; rows that repeat are changed alike. The key is the
    session's setting; without one it is random and known to this process only. An empty table
    gives no rows.
    """
    return pii.pseudonymize(docs, pseudonym_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents in the order of the mixture.

    A null source is a source of its own; null and empty texts have size 1. Rows that share an id
    stand in the order of a hash of their text, equal rows in any. An empty table gives no rows.
    """
    return mixing.mix(docs, ordered=True).select("the_row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, by sequence and offset; sequences are numbered in the order of the mixture.

    Files read again come in any order, so the mixture's is computed anew here: it depends on the
    documents alone. Small groups keep the documents of a sequence near each other in that order:
    of the first tokens by sequence_id and offset, a source has its share to within a few blocks.
    Null and empty texts are packed as their end id. Rows that repeat are packed each, null ids
    stay null. An empty table gives no rows.
    """
    rows = mixing.mix(docs, ordered=True).select("the_row.*")
    return packing.pack(rows, packing.Packing(tokenizer_file("byte_bpe_50k.json"), group=GROUP, ordered=True, cache_pieces=CACHE_PIECES))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained model, a graph and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages wrote on the way is deleted as soon as the next has read it."""
    docs, written = load(spark, sf_dir, "documents"), None
    with scratch_scope() as whole:
        for name, stage in STAGES:
            with scratch_scope() as own:
                docs = own.keep(materialize(stage(spark, docs, sf_dir), name.replace(" ", "-")))
            if written is not None:
                discard(written)
            written = docs
        return whole.keep(docs)
