"""The whole pipeline on tables with nulls, repeats, clashing names and nothing at all, and what it leaves behind."""

import corpus_pipeline
from lithic.llm.common import shared_folder
from tests.llm.test_copies import split

NAMES = ["key", "id", "the_row", "component_id", "slot", "place", "size", "block", "fp", "found", "new", "kept", "probability", "named", "bucket", "start"]


def put(spark, df, path, labels="doc_id long, quality int, toxic int", marks=()):
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(marks), labels).write.parquet(f"{path}/labels.parquet")
    return str(path)


def left(spark):
    import pathlib

    folder = pathlib.Path(shared_folder(spark).removeprefix("file://")) / "lithic"
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


def check(spark, df, path, marks=()):
    before = left(spark)
    out = corpus_pipeline.run(spark, put(spark, df, path, marks=marks))
    rows = out.collect()
    assert {p.rsplit("-", 1)[0] for p in left(spark) - before} == {"packing"}, "only the result stays"
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for pieces in by.values():
        # As many whole documents as their pieces make.
        assert sum(p.length for p in pieces) % pieces[0].doc_tokens == 0
    return rows


def test_hard_rows(spark, hard, tmp_path):
    alone = " ".join(f"word{k} of its own" for k in range(30))
    hard = hard.union(spark.createDataFrame([(None, alone, None, None, None, "x", 1, 2.5, ["y"])], hard.schema))
    rows = check(spark, hard, tmp_path, marks=[(1, 1, 0), (1, 0, 0), (None, 0, 0), (4, None, None)])
    long = {(r.doc_id, r.text) for r in hard.collect() if len(split(r.text)) >= 10}
    ids = {r.doc_id for r in rows}
    assert ids <= {d for d, _ in long} and None in ids, "a row without an id stays"


def test_clashing_names(spark, docs, tmp_path):
    df = docs.selectExpr("*", *[f"doc_id AS {n}" for n in NAMES])
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.pseudonyms, corpus_pipeline.mix_sources):
        got = stage(spark, df, "")
        assert got.dtypes == df.dtypes and all(r.doc_id == r[n] for r in got.collect() for n in NAMES)
    assert {r.doc_id for r in check(spark, df, tmp_path / "a")} == {r.doc_id for r in check(spark, docs, tmp_path / "b")}


def test_empty_table(spark, empty, tmp_path):
    assert check(spark, empty, tmp_path) == []


def test_stages_on_nulls_alone(spark, tmp_path):
    df = spark.createDataFrame([(None, None, None, None, None)] * 3, "doc_id long, text string, lang string, source string, n_chars int")
    assert check(spark, df, tmp_path) == []
    assert corpus_pipeline.near_duplicates(spark, df, "").count() == 1
    assert corpus_pipeline.pseudonyms(spark, df, "").count() == 3
    assert corpus_pipeline.mix_sources(spark, df, "").count() == 3
    assert [r.length for r in corpus_pipeline.pack_sequences(spark, df, "").collect()] == [1, 1, 1]
