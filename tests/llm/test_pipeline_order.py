"""The mixture's order reaches the numbers of the packed sequences."""

import random
from collections import defaultdict

import corpus_pipeline
from lithic.llm import mixing
from lithic.llm.common import materialize
from tests.llm.conftest import sentence


def test_prefixes_of_sequences_hold_the_shares(spark):
    r = random.Random(4)
    # Sources of unlike sizes and lengths, one with texts of more than a sequence, in files of unlike sizes.
    rows = [(i, sentence(r, 900 if i % 7 == 0 else r.choice([60, 200, 400])), "en", ("long" if i % 7 == 0 else "a" if i % 3 else "b"), 0) for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    mixed = materialize(corpus_pipeline.mix_sources(spark, docs, ""), "mixed")
    packed = corpus_pipeline.pack_sequences(spark, mixed, "").collect()
    source, size = {x[0]: x[3] for x in rows}, {x[0]: len(x[1]) for x in rows}
    tokens = {x.doc_id: x.doc_tokens for x in packed}
    # Characters by source in the packed order against the mixture's own.
    place = {x.the_row.doc_id: (x.slot, x.place) for x in mixing.mix(docs).collect()}
    got, want = defaultdict(float), defaultdict(int)
    order, done, worst = sorted(place, key=place.get), 0, 0.0
    total, chars = sum(tokens.values()), 0.0
    for x in sorted(packed, key=lambda x: (x.sequence_id, x.offset)):
        part = size[x.doc_id] * x.length / tokens[x.doc_id]
        got[source[x.doc_id]] += part
        chars += part
        while done < len(order) and sum(want.values()) + size[order[done]] <= chars:
            want[source[order[done]]] += size[order[done]]
            done += 1
        worst = max(worst, max(abs(got[s] - want[s]) for s in ("a", "b", "long")))
    assert total == sum(x.length for x in packed) and done >= len(order) - 1
    # A group of 256 documents is about 5 blocks here, of some 50 in all.
    assert worst < 3 * mixing.Mixing().block, worst / mixing.Mixing().block
