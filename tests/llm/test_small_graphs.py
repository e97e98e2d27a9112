"""What is small is solved by one task: components of few edges, and the training of the quality model."""

import random

import numpy as np
import pytest

from lithic.llm import quality, simhash
from tests.llm.conftest import sentence


def jobs(spark, run):
    """What `run` returns, and the number of jobs that it started."""
    sc = spark.sparkContext
    group = f"counted-{random.random()}"
    sc.setJobGroup(group, group)
    try:
        out = run()
        return out, len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def edges_of(spark, r, nodes, many):
    pairs = {(max(a, b), min(a, b)) for a, b in ((r.randrange(nodes), r.randrange(nodes)) for _ in range(many)) if a != b}
    return spark.createDataFrame([(a - nodes // 2, b - nodes // 2) for a, b in pairs], "u long, v long").repartition(7)


@pytest.mark.parametrize("bound", [0, 40, 1 << 14])
def test_components_by_stars_and_at_once(spark, monkeypatch, bound):
    """By rounds alone, by rounds until few edges are left, and in one task: the same roots."""
    monkeypatch.setattr(simhash, "SMALL_GRAPH", bound)
    r = random.Random(3)
    edges = edges_of(spark, r, 150, 90)
    rows = [(e.u, e.v) for e in edges.collect()]
    root = {x: x for e in rows for x in e}
    for _ in root:
        for u, v in rows:
            root[u] = root[v] = min(root[u], root[v])
    got = [(e.node, e.root) for e in simhash.components(edges).collect()]
    assert len(got) == len(dict(got)) and dict(got) == {x: y for x, y in root.items() if x != y}


def test_no_edges(spark):
    assert simhash.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_few_edges_take_few_jobs(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(400)], "u long, v long")
    out, n = jobs(spark, lambda: simhash.components(chain))
    assert {e.root for e in out.collect()} == {0} and out.count() == 400
    assert n <= 8, "rounds of joins for a graph that fits in a task"


def test_training_sends_the_model_only(spark, monkeypatch):
    """Features stay on executors, and the model is that of training on the same rows."""
    r = random.Random(9)
    rows = [(i, sentence(r, 40) if i % 2 else " ".join(["zzz qqq"] * 3 + [sentence(r, 25)])) for i in range(90)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    found = quality.labelled_features(docs, labels, quality.Rules()).orderBy("id").collect()
    want = quality.train(np.array([np.frombuffer(f.x, np.float16) for f in found]), np.array([f.quality for f in found]))

    def refuse(*_):
        raise AssertionError("features on the driver")

    monkeypatch.setattr(type(docs), "toArrow", refuse)
    got = quality.fit(docs, labels)
    assert np.allclose(got.weights, want.weights, rtol=1e-6, atol=1e-9)
    assert np.allclose([got.bias, got.slope, got.shift], [want.bias, want.slope, want.shift], rtol=1e-5)
