"""The pipeline's near-duplicate stage, against brute force."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lithic.llm import jaccard, simhash
from lithic.llm.common import load, materialize
from tests.llm.conftest import sentence
from tests.llm.test_copies import pairs, split

SF = "/root/testdata/sf0.01"


def plain_sets(texts):
    words = [split((t or "").lower()) for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def plain_kept(rows):
    """The smallest id of each component of texts with a similarity of 0.8 or more."""
    sets = plain_sets([t for _, t in rows])
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return sorted(least.values())


def edited(r, base):
    words = base.split()
    for _ in range(r.randint(0, 14 * max(1, len(words) // 500))):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("pairs_a_copy", [jaccard.PAIRS_A_COPY, 3])
def test_stage_equals_brute_force(spark, docs, empty, monkeypatch, pairs_a_copy):
    """Copies on both sides of the threshold, in a group large enough that hubs alone would not do."""
    monkeypatch.setattr(jaccard, "PAIRS_A_COPY", pairs_a_copy)
    r = random.Random(11)
    bases = [sentence(r, n) for n in (60, 120, 240, 500, 1500)]
    rows = [(10_000 + 7 * i % 997, edited(r, r.choice(bases)).upper() if i % 9 == 0 else edited(r, r.choice(bases))) for i in range(250)]
    rows += pairs(docs)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = corpus_pipeline.near_duplicates(spark, df, SF)
    assert sorted(x.doc_id for x in kept.collect()) == plain_kept(rows)
    assert corpus_pipeline.near_duplicates(spark, empty, SF).count() == 0


def test_texts_of_many_pairs_are_spread(spark):
    """A star: every pair has the same text on one side, and no task gets most of them."""
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(k, text) for k in range(2001)], "doc_id long, text string")
    star = materialize(spark.range(1, 2001).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v")), "star")
    found = jaccard._verified(star, docs).withColumn("part", F.spark_partition_id())
    rows = found.collect()
    assert sorted(x.u for x in rows) == list(range(1, 2001)) and {x.v for x in rows} == {0}
    assert max(collections.Counter(x.part for x in rows).values()) < 1200


def test_stage_on_given_documents(spark):
    df = load(spark, SF, "documents")
    kept = corpus_pipeline.near_duplicates(spark, df, SF)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.select("doc_id").collect()) == plain_kept(pairs(df))


def test_simhash_comes_first(spark, monkeypatch):
    """All pairs that its grid finds, and no others, are compared first; similar texts further apart are still found."""
    r = random.Random(4)
    rows = []
    for base in [sentence(r, n) for n in (300, 900, 900)]:
        for _ in range(30):
            words = base.split()
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
            rows.append((1000 + len(rows) * 37 % 991, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked, inner = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, docs: (asked.append({(x.u, x.v) for x in pairs.collect()}), inner(pairs, docs))[1])
    kept = corpus_pipeline.near_duplicates(spark, df, SF)
    assert sorted(x.doc_id for x in kept.collect()) == plain_kept(rows)
    marks = {d: simhash.majority(jaccard.shingles(t)) for d, t in rows}
    near = lambda u, v: (marks[u] ^ marks[v]).bit_count() <= 3
    assert asked[0] and all(near(u, v) for u, v in asked[0])
    met = {d for pair in asked[0] for d in pair}
    assert met == {d for d in marks if any(near(d, x) for x in marks if x != d)}
    assert any(not near(u, v) for u, v in asked[1] | asked[2])


def test_grid_pairs_connect_all_within_the_radius(spark):
    r = random.Random(8)
    marks = {r.getrandbits(64) for _ in range(300)}
    for base in list(marks)[:20]:
        for _ in range(30):
            for _ in range(r.randint(1, 2)):
                base ^= 1 << r.randrange(64)
            marks.add(base)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    classes = spark.createDataFrame([(signed(x),) for x in marks], "fp long")
    found = [(x.u, x.v) for x in simhash.near_pairs(classes).collect()]
    assert all(u > v and ((u ^ v) & (1 << 64) - 1).bit_count() <= 3 for u, v in found) and len(set(found)) == len(found)

    def parts(links):
        root = {signed(x): signed(x) for x in marks}
        for a, b in links:
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[a] = b
        return sorted(sorted(x for x in root if top(root, x) == t) for t in {top(root, x) for x in root})

    def top(root, x):
        while root[x] != x:
            x = root[x]
        return x

    every = [(signed(a), signed(b)) for a in marks for b in marks if a < b and (a ^ b).bit_count() <= 3]
    assert parts(found) == parts(every)


def test_unlike_rows_under_one_id_stay(spark, hard):
    kept = corpus_pipeline.near_duplicates(spark, hard, SF)
    assert kept.dtypes == hard.dtypes
    got = [x.text for x in kept.collect()]
    assert "another text under a used id" in got and len(got) < hard.count()


def test_order_of_shingles_does_not_matter():
    """Any common order leaves a shared shingle in the prefixes of similar sets."""
    import numpy as np

    r = random.Random(2)
    for _ in range(300):
        base = sentence(r, r.randint(3, 80))
        a, b = (jaccard.shingles(edited(r, base)) for _ in range(2))
        common = np.unique(np.array(r.sample(a.tolist(), len(a) // 2), np.uint64))
        seen = np.array([r.randint(2, 9) for _ in common], np.int64)
        differ = sum((x ^ y).bit_count() for x, y in zip(jaccard.bitmap(a).view("u8").tolist(), jaccard.bitmap(b).view("u8").tolist()))
        count = lambda h: np.frombuffer(jaccard.counts(h), np.uint8).astype(int)
        assert differ <= np.abs(count(a) - count(b)).sum() <= len(np.setxor1d(a, b))
        if jaccard.similar(a, b):
            assert 9 * differ <= len(a) + len(b)
            assert set(jaccard.prefix(a, common, seen).tolist()) & set(jaccard.prefix(b, common, seen).tolist())
