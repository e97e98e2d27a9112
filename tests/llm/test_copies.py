"""Operators that find copies, against brute force."""

import base64
import hashlib
from collections import Counter, defaultdict

import xxhash

from lithic.llm import chunking, simhash, substrings

SPACES = " \t\n\x0b\x0c\r"


def split(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACES:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = split(lower)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_classes(rows):
    """Fingerprints, each row's class, and the smallest id of each class (None without any)."""
    fp = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                root[top(i)] = top(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[top(i)].append(d)
    known = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return fp, [top(i) for i in range(len(rows))], known


def plain_components(rows):
    fp, of, known = plain_classes(rows)
    return sorted(((d, f"{fp[i]:016x}", known[of[i]]) for i, (d, _) in enumerate(rows)), key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_simhash_equals_brute_force(docs, hard, empty):
    for df in (docs, hard, empty):
        got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
        assert got == plain_components(pairs(df))


def test_links_lose_nothing(spark):
    """Chains of fingerprints 1, 2 and 3 bits apart, at every place of the word."""
    fps = {0}
    for start in (0x123456789ABCDEF0, 0, (1 << 64) - 1):
        x = start
        for k in range(60):
            fps.add(x)
            for b in range(1 + k % 4):
                x ^= 1 << (k * 7 + b * 11) % 64
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f, f) for f in signed], "fp long, root long")
    want = {(max(a, b), min(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert want and {(r.u, r.v) for r in simhash.links(df).collect()} == want


def test_a_dense_family_needs_few_links(spark):
    """All fingerprints within one bit of another: hubs give a few links a member, and the rest is found."""
    import itertools

    base = 0x0F1E2D3C4B5A6978
    family = sorted({base} | {base ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(64), 2)})
    signed = [f - (1 << 64) if f >> 63 else f for f in family]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    assert simhash.hub_links(df).count() <= 6 * len(family)
    assert len({r.root for r in simhash.rooted(df).collect()}) == 1


def test_a_star_of_most_edges_is_split(spark):
    wide = spark.newSession()
    for k, v in {"autoBroadcastJoinThreshold": "-1", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "adaptive.skewJoin.skewedPartitionFactor": "2", "adaptive.advisoryPartitionSizeInBytes": "16k", "adaptive.coalescePartitions.enabled": "false"}.items():
        wide.conf.set(f"spark.sql.{k}", v)
    pairs = wide.range(0, 200_000, numPartitions=8).selectExpr("IF(id % 50 = 0, id, 7) AS a", "id + 1000000 AS b")
    met = simhash.with_least(pairs)
    assert met.where("m <= a").groupBy().count().first()[0] == 200_000
    met.write.format("noop").mode("overwrite").save()
    met.collect()
    assert "skew=true" in met._jdf.queryExecution().executedPlan().toString()


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(1001, 1000)], "u long, v long")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {**{i: 0 for i in range(1, 201)}, 1001: 1000}


def test_deduplicate_keeps_one_of_each(docs, hard, empty):
    named = docs.selectExpr("*", "1 AS key", "2 AS id", "3 AS the_row", "4 AS component_id", "5 AS stay_id", "6 AS fingerprint")
    for df in (docs, named, hard, hard.selectExpr("*", "2 AS id", "3 AS the_row", "4 AS component_id"), empty):
        kept = simhash.deduplicate(df)
        assert kept.columns == df.columns and kept.dtypes == df.dtypes
        rows = pairs(df)
        # One row of each class, with its smallest id; unlike rows under one id, and without one, all stay.
        fp, of, known = plain_classes(rows)
        of_text = {}
        for (_, text), c in zip(rows, of):
            of_text[text] = c
        got = sorted(((of_text[t], d) for d, t in pairs(kept)), key=repr)
        assert got == sorted(known.items(), key=repr)


def plain_removal(rows):
    words = [split(t) for _, t in rows]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substrings_equal_brute_force(docs, hard, empty):
    for df in (docs, hard, empty):
        for batches in (1, 3):
            got = substrings.remove_repeats(df, batches)
            assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=repr) == plain_removal(pairs(df))


def test_kept_text(docs):
    got = {r.doc_id: r for r in substrings.remove_repeats(docs, with_text=True).collect()}
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got.values())
    assert len(got) == docs.count()


def test_words_decide_where_hashes_collide(docs):
    """With hashes of 3 bits most claims are false, and the words refute them."""
    got = substrings.remove_repeats(docs, bits=3)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=repr) == plain_removal(pairs(docs))


def spans(df):
    return {(a["fp"], a["span"]) for r in df.collect() for a in r.anchors}


def test_index_is_reopened_by_another_session(spark, docs, tmp_path):
    """Eight batches, each added by a session of its own, which finds what those before have added."""
    table = substrings.anchor_table(docs.selectExpr("doc_id AS key", "text")).cache()
    path, seen, rewritten = f"file://{tmp_path}/index", set(), 0
    for k in range(8):
        index = substrings.RunIndex(spark.newSession(), path, buckets=4, fanout=2)
        batch = table.where(f"key % 8 = {k}")
        run = index.ingest(k, substrings.places(batch))
        assert {(r.fp, r.span) for r in index.matches(run).collect()} == spans(batch) & seen
        before = {r.name for r in index.runs}
        index.commit(run)
        rewritten += sum(index.read(r).agg({"n": "sum"}).first()[0] for r in index.runs if r.name not in before | {run.name})
        seen |= spans(batch)
    index = substrings.RunIndex(spark.newSession(), path)
    assert [(r.level, r.low, r.high) for r in index.runs] == [(3, 0, 7)] and index.next == 8
    rows = index.rows().collect()
    total = sum(len(r.anchors) for r in table.collect())
    assert {(r.fp, r.span) for r in rows} == seen and len(rows) == len(seen) and sum(r.n for r in rows) == total
    assert rewritten <= 3 * total, "each occurrence at most once a level"
    assert index.ingest(3, substrings.places(table)) is None, "a batch that is committed changes nothing"
    run = index.ingest(8, substrings.places(table))
    plan = index.read(run).join(index.read(index.runs[0]).hint("merge"), ["fp", "span"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan, "history does not move"


def test_a_writer_that_breaks_off_leaves_the_old_state(spark, docs, tmp_path):
    table = substrings.anchor_table(docs.selectExpr("doc_id AS key", "text")).cache()
    path = f"file://{tmp_path}/index"
    index = substrings.RunIndex(spark, path, buckets=4, fanout=2)
    index.commit(index.ingest(0, substrings.places(table)))
    want = sorted(map(tuple, index.rows().collect()))
    # A run without a manifest, a merged run without one, and a manifest that was cut short.
    index.ingest(1, substrings.places(table))
    index._write(index.read(index.runs[0]).sortWithinPartitions("fp", "span"), substrings.Run("run-torn", 1, 0, 1))
    (tmp_path / "index" / "manifest" / f"{index._versions()[-1] + 1:012d}").write_text('{"buckets": 4, "fan')
    again = substrings.RunIndex(spark, path)
    assert again.next == 1 and sorted(map(tuple, again.rows().collect())) == want
    other = substrings.RunIndex(spark, path)
    again.commit(again.ingest(1, substrings.places(table)))
    assert again.next == 2 and len(again.runs) == 1 and {r.n for r in again.rows().collect()} == {2 * x[2] for x in want}
    assert sorted(p.name for p in (tmp_path / "index" / "runs").iterdir()) == [again.runs[0].name], "nothing torn stays"
    import pytest

    with pytest.raises(RuntimeError):
        other.commit(other.ingest(1, substrings.places(table)))


def plain_chunks(data):
    ends, at = [], 0
    while at < len(data):
        if len(data) - at <= chunking.SHORTEST:
            at = len(data)
        else:
            for end in range(at + chunking.SHORTEST, len(data) + 1):
                h = 0
                for b in data[max(0, end - chunking.WINDOW) : end]:
                    h = (h * 2 + int(chunking.GEAR[b])) & 0xFFFF
                bits = chunking.STRICT if end < at + chunking.NORMAL or end == at + chunking.NORMAL and h >> 16 - chunking.STRICT == 0 else chunking.LOOSE
                if h >> 16 - bits == 0 or end == at + chunking.LONGEST or end == len(data):
                    break
            at = end
        ends.append(at)
    return ends


def test_boundaries_equal_a_rolling_loop(texts):
    for t in texts:
        data = (t or "").encode()[:3000]
        assert chunking.boundaries(data) == plain_chunks(data)


def test_chunks_resist_shifts(texts):
    a = texts[-2].encode()
    assert chunking.containment(chunking.chunks(a), chunking.chunks(b"new words in front " + a)) > 0.95


def test_fingerprint_text_round_trip(texts):
    for t in texts:
        found = chunking.chunks((t or "").encode())
        assert chunking.from_text(chunking.to_text(found)) == found
        assert len(base64.b64decode(chunking.to_text(found))) == 9 * len(found)


def test_edited_texts(docs, hard, empty, spark):
    for df in (docs, hard, empty, docs.where("doc_id = 1")):
        rows = sorted(((d, t or "") for d, t in pairs(df)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        want = []
        for i, (d, t) in enumerate(rows):
            following = rows[i - 1][1]
            edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
            own, new, other = (chunking.chunks(x.encode()) for x in (t, edited, following))
            want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), chunking.to_text(own), chunking.to_text(new), chunking.containment(own, new), chunking.containment(own, other)))
        got = [tuple(r) for r in chunking.compare_edited(df).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    long = [r for r in chunking.compare_edited(docs).collect() if r.n_chars > 800]
    assert all(0.5 < r.near_edited < 0.8 or r.near_next > 0.5 or r.near_edited == 1 for r in long)


def test_plain_fingerprints(docs):
    got = {r.doc_id: (r.n_chars, r.fingerprint) for r in chunking.fingerprint(docs).collect()}
    assert got == {d: (len(t or ""), chunking.to_text(chunking.chunks((t or "").encode()))) for d, t in pairs(docs)}
