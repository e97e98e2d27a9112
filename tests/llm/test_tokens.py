"""Operators on token ids, against the tokenizer library itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithic.llm import ledger, packing, planes, tokens
from lithic.llm.queries import tokenizer_file

BYTES, WORDS = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")

ODD = ["a  b   c\n\n d\t'sx ''s I'LL we’ll  ", "  ", "\n", "½²x 12,3.4!!! ñandú ÀÉ ǆ", "<|endoftext|> x <|startoftext|>", "  x y İI", "ſtraße \x1c\x85 z", "a.,b ,c .d", "~ a~b § x", "x.\ny,\n,z", "\tq\tr ", "it's 'd x'll.", "\0 nul"]


def whole(path, text, end):
    return tokens.encoder(path)._whole([text or ""])[0] + [end]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_library(texts, path):
    enc = tokens.Encoder(path)
    r = random.Random(1)
    made = ["".join(r.choices(" \n\t.,'ab1é!-~\xa0”", k=r.randint(0, 30))) for _ in range(3000)]
    given = [t or "" for t in texts] + ODD + made
    got = enc.ids(given)
    assert [list(x) for x in got] == [e.ids for e in enc.library.encode_batch(given, add_special_tokens=False)]
    assert [list(x) for x in enc.ids(given)] == [list(x) for x in got]


def test_cache_starts_anew(texts, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    enc = tokens.Encoder(BYTES)
    given = [t or "" for t in texts]
    for t in given:
        assert list(enc.ids([t])[0]) == enc._whole([t])[0]


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_packing_holds_every_id_once(docs, hard, empty):
    p = packing.Packing(BYTES, with_ids=True, group=40)
    for df in (docs, hard, empty):
        pieces = packing.pack(df, p).collect()
        sequences, by_doc = defaultdict(list), defaultdict(list)
        for x in pieces:
            assert x.length == len(x.ids) > 0 and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
            sequences[x.sequence_id].append((x.offset, x.length))
            by_doc[x.doc_id, x.doc_tokens].append(x)
        for s in sequences.values():
            end = 0
            for offset, length in sorted(s):
                assert offset == end
                end += length
            assert end <= 1024 and end & (end - 1) == 0, "no sequence needs padding"
        want = sorted(tuple(whole(BYTES, t, 0)) for _, t in rows_of(df))
        assert sum(len(w) for w in want) == sum(x.length for x in pieces)
        if df is docs:
            got = []
            for v in by_doc.values():
                v.sort(key=lambda x: x.start)
                assert [x.start for x in v] == list(np.cumsum([0] + [x.length for x in v])[:-1])
                got.append(tuple(i for x in v for i in x.ids))
            assert sorted(got) == want


def test_packing_balances_cost():
    r = random.Random(3)
    lengths = [r.randint(1, 1023) for _ in range(800)]
    p = packing.Packing("")
    cost, cuts = defaultdict(float), defaultdict(int)
    for item, _, n, seq, _ in packing.assign(lengths, p):
        cost[seq] += n + n * n / p.quadratic
        cuts[item] += 1
    full = [c for s, c in cost.items() if s < sum(lengths) // 1024]
    assert max(full) < 1.1 * sum(full) / len(full)
    assert sum(c > 1 for c in cuts.values()) < len(full) * 1.2


def plain_assign(lengths, p):
    """Each sequence asked in turn."""
    cost = lambda n: n + n * n / p.quadratic
    sequences = [[cost(p.capacity - r), i, r, 0] for i, r in enumerate(packing.capacities(sum(lengths), p.capacity))]
    out = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at, left = 0, lengths[item]
        while left:
            s = min([x for x in sequences if x[2] >= left] or [x for x in sequences if x[2]])
            n = min(left, s[2])
            out.append((item, at, n, s[1], s[3]))
            s[0], s[2], s[3], at, left = s[0] + cost(n), s[2] - n, s[3] + n, at + n, left - n
    return out


@pytest.mark.parametrize("seed", range(6))
def test_documents_are_cut_only_where_no_sequence_has_room(seed):
    r = random.Random(seed)
    lengths = [[r.randint(1, 1023), min(1023, int(r.lognormvariate(5, 1)) + 1), r.choice([1, 512, 1023]), 7][seed % 4] for _ in range(400)]
    p = packing.Packing("", capacity=1024 if seed < 4 else 100)
    assert packing.assign(lengths, p) == plain_assign(lengths, p)


def plain_file_rows(df):
    out, start = [], 0
    tie = {r.text: r.h for r in df.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()}
    for d, t in sorted(rows_of(df), key=lambda x: (x[0] is not None, x[0] or 0, tie[x[1] or ""])):
        ids = whole(WORDS, t, 2)
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_round_trip(spark, docs, hard, empty, tmp_path):
    for k, (df, chunk, bits) in enumerate(((docs, 1000, False), (hard, 64, True), (empty, 64, False), (docs, 1 << 16, True))):
        path = f"file://{tmp_path}/{k}"
        planes.write(df, path, WORDS, 2, chunk, bits)
        got = [tuple(r) for r in planes.read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
        assert sorted(got, key=lambda r: r[1]) == plain_file_rows(df)
    stream = [i for r in sorted(planes.read_ids(spark, f"file://{tmp_path}/0").collect(), key=lambda r: r.start) for i in r.ids]
    assert stream == [i for d, t in sorted(rows_of(docs)) for i in whole(WORDS, t, 2)]
    for a, z in ((0, 1), (990, 1010), (3000, 7777), (len(stream) - 5, len(stream) + 5), (5, 5), (len(stream), len(stream) + 9)):
        rows = sorted(planes.read_range(spark, f"file://{tmp_path}/0", a, z).collect(), key=lambda r: r.start)
        assert [i for r in rows for i in r.ids] == stream[a:z] and (not rows or rows[0].start == a)


def test_rows_of_one_id_are_spread(spark, tmp_path):
    df = spark.range(20_000).selectExpr("CAST(NULL AS long) AS doc_id", "'the same text' AS text")
    planes.write(df, f"file://{tmp_path}/x", WORDS, 2, 1000)
    sizes = [r[1] for r in spark.read.parquet(f"{tmp_path}/x/index").groupBy("shard").agg({"n_ids": "sum"}).collect()]
    assert len(sizes) >= 6 and max(sizes) < 0.4 * sum(sizes)


@pytest.mark.parametrize("bits", [False, True])
def test_blocks_round_trip(bits):
    r = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (7, 256), (1000, 49408), (65536, 65536), (33, 1 << 24), (5, (1 << 32) - 1)):
        ids = r.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        assert (planes.decode_block(planes.encode_block(ids, bits)) == ids).all()


def test_checksums_combine():
    data = random.Random(2).randbytes(5000)
    for cut in (0, 1, 17, 4096, 5000):
        assert planes.shifted_crc(zlib.crc32(data[:cut]), len(data) - cut) ^ planes.shifted_crc(zlib.crc32(data[cut:]), 0) == zlib.crc32(data)


def test_ledger(spark, docs, hard, empty, tmp_path):
    names = {"b@1": BYTES}
    for k, df in enumerate((docs, hard, empty)):
        book = ledger.Ledger(spark, f"file://{tmp_path}/{k}")
        assert book.totals().count() == 0
        # Columns that are called like the counts.
        given = df.selectExpr("doc_id", "source", "lang", "text", "substr(text, 1, 20) AS short", "'x' AS old", "lang AS new", "1 AS the_row", "2 AS t0")
        counted = ledger.count_tokens(given, {"text": "old", "short": "new"}, names).cache()
        versions = ledger.versions(names)
        inserts = ledger.deltas(counted, versions, new="old")
        assert book.apply("one", inserts) and not book.apply("one", inserts)
        assert book.apply("two", ledger.deltas(counted.where("the_row.doc_id % 2 = 0"), versions, new="new", old="old"))
        assert book.apply("three", ledger.deltas(counted.where("the_row.doc_id % 5 = 1"), versions, old="old"))
        # A revision that takes documents to another source.
        moved = counted.where("the_row.doc_id % 7 = 2").withColumn("to", F.lit("elsewhere"))
        assert book.apply("four", ledger.deltas(moved, versions, new="old", old="old", new_source="to"))
        want = defaultdict(lambda: [0, 0])
        for r in df.select("doc_id", "source", "lang", "text").collect():
            long, short = r.text or "", (r.text or "")[:20]
            for name, f in ((ledger.WORDS, lambda t: len(t.encode().split())), ("b@1", lambda t: len(whole(BYTES, t, 0)) - 1)):
                even, gone, move = (r.doc_id is not None and r.doc_id % m == x for m, x in ((2, 0), (5, 1), (7, 2)))
                group = want[r.source, r.lang, name]
                group[0] += 1 - gone - move
                group[1] += (f(short) if even else f(long)) - gone * f(long) - move * f(long)
                if move:
                    want["elsewhere", r.lang, name][0] += 1
                    want["elsewhere", r.lang, name][1] += f(long)
        want = {k: tuple(v) for k, v in want.items() if any(v)}
        read = lambda: {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in book.totals().collect()}
        assert read() == want
        for _ in range(3):
            book.compact()
            assert read() == want and not book.apply("two", inserts)
            assert book._names("batch") == [] and len(book._names("base")) == 1, "what is merged is gone"
        assert book.apply("five", inserts) and not book.apply("five", inserts)


def test_a_compaction_that_breaks_off_changes_nothing(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/y")
    rows = spark.createDataFrame([("s", "en", "w", 1, 5)], ledger.DELTA)
    assert book.apply("a", rows) and book.apply("b", rows)
    # Names written, base not committed.
    spark.createDataFrame([("a",), ("b",)], "batch string").write.parquet(f"{tmp_path}/y/names/000000000000")
    rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{tmp_path}/y/base/000000000000")
    assert book.totals().first().n_tokens == 10 and not book.apply("a", rows)
    # Base committed, a merged batch not yet deleted.
    kept = f"{tmp_path}/y/batch/a"
    import shutil

    shutil.copytree(kept, f"{tmp_path}/kept")
    book.compact()
    shutil.copytree(f"{tmp_path}/kept", kept)
    assert book.totals().first().n_tokens == 10 and not book.apply("a", rows)


def test_registered_token_counts(spark):
    """The whole query against a plain count."""
    import re

    from lithic.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    labels = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        labels[r.doc_id].append((r.quality, r.toxic))
    want = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        marks = labels.get(r.doc_id)
        if marks and max(t for _, t in marks) == 1:
            continue
        text = re.sub("[#*$%&|<>]", "", r.text or "") if marks and min(q for q, _ in marks) == 0 else r.text or ""
        for name, n in ((ledger.WORDS, len(text.encode().split())), ("byte_bpe_50k@1", len(whole(BYTES, text, 0)) - 1)):
            want[r.source, r.lang, name][0] += 1
            want[r.source, r.lang, name][1] += n
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in QUERIES["op10_token_counts"](spark, sf).collect()}
    assert got == dict(want)


def test_a_broken_batch_is_not_counted(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/x")
    rows = spark.createDataFrame([("s", "en", "w", 1, 5)], ledger.DELTA)
    rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{tmp_path}/x/batch/half")
    assert book.totals().count() == 0
    assert book.apply("half", rows) and book.totals().first().n_tokens == 5


def test_other_operators_drop_the_encoders(docs, monkeypatch):
    """A worker that packed texts and now serves another stage of the pipeline holds no encoder."""
    from lithic.llm import jaccard, quality

    taken, kind = [], type(docs)
    inner = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: (taken.append(f), inner(self, f, *a, **b))[1])
    quality.score(docs, None)
    quality.score(docs, None, keep_columns=True)
    jaccard._classes(docs)
    jaccard._prefixes(docs, np.empty(0, np.uint64), np.empty(0, np.int64))
    assert len(taken) == 4
    for f in taken:
        tokens.encoder(BYTES).ids(["some words"])
        list(f(iter([])))
        assert not tokens._encoders
