"""Content-defined chunking: document fingerprints that survive insertions.

A gear hash rolls over the UTF-8 bytes; a boundary falls where its upper bits are zero,
with more bits required before the normal size than after it. A fingerprint is the set of
a text's chunk digests, each with its chunk's length; containment is the share of a text's
distinct chunk length that another text holds too.
"""

from __future__ import annotations

import base64
import bisect
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, sliced, small_batches, text_or_empty

#: Bytes of the shortest, normal and longest chunk; zero bits required before and after the normal size.
SHORTEST, NORMAL, LONGEST = 12, 40, 160
STRICT, LOOSE = 6, 4
#: Bytes that a hash depends on.
WINDOW = 16

#: The gear table, from a rule: digests of 0..255.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([k]), 2024) for k in range(256)], dtype=np.uint32)


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of `data`."""
    n = len(data)
    if n <= SHORTEST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    s = 1
    while s < WINDOW:
        # The hash of 2s bytes from two hashes of s bytes.
        wide = h.copy()
        wide[s:] += h[:-s] << np.uint32(s)
        h, s = wide, 2 * s
    top = (h & np.uint32(0xFFFF)) >> np.uint32(WINDOW - STRICT)
    strict = (np.flatnonzero(top == 0) + 1).tolist()
    loose = (np.flatnonzero(top < 1 << (STRICT - LOOSE)) + 1).tolist()
    out, at = [], 0
    while n - at > SHORTEST:
        k = bisect.bisect_left(strict, at + SHORTEST)
        end = strict[k] if k < len(strict) else n + LONGEST
        if end > at + NORMAL:
            k = bisect.bisect_left(loose, at + NORMAL)
            end = min(end, loose[k] if k < len(loose) else end, at + LONGEST)
        at = min(end, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunks(data: bytes) -> dict[int, int]:
    """64-bit digest -> length of each distinct chunk."""
    out, at = {}, 0
    digest = xxhash.xxh3_64_intdigest
    for end in boundaries(data):
        out[digest(data[at:end])] = end - at
        at = end
    return out


_RECORD = np.dtype([("digest", "<u8"), ("length", "u1")])


def to_text(found: dict[int, int]) -> str:
    """Base64 of (digest, length) records in order of digest."""
    a = np.empty(len(found), _RECORD)
    a["digest"], a["length"] = list(found), list(found.values())
    return base64.b64encode(np.sort(a, order="digest").tobytes()).decode()


def from_text(fingerprint: str) -> dict[int, int]:
    a = np.frombuffer(base64.b64decode(fingerprint), _RECORD)
    return dict(zip(a["digest"].tolist(), a["length"].tolist()))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of the length of a's chunks that are also b's; of two empty sets 1, else of an empty one 0."""
    if not a:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row, without any exchange.

    Null text counts as empty, and the empty text has the empty fingerprint. Texts are taken
    whole, however long. Rows that repeat are fingerprinted each, a null doc_id stays null, and
    there are no ties. An empty table gives no rows. Other columns, whatever their names, are not read.
    """

    def run(batches):
        for b in sliced(batches, 512):
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array([to_text(chunks(t.encode())) for t in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


#: Stands for a null doc_id, which comes after all others in descending order.
NO_ID = -(1 << 63)


def with_next(docs: DataFrame, f, schema: str) -> DataFrame:
    """Map (doc_id, text, next document's text) of every row, next in descending (doc_id, text) and
    after the last the first, with one exchange of the texts.

    Ranges of ids go to partitions; a range's largest document is sent to the range above as
    well, where it is the next one of the smallest. `f(rows)` gets an iterator of such triples
    and yields record batches.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_or_empty().alias("text"))
    share = F.array(*[F.lit(k / n) for k in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    at = rows.agg(F.percentile_approx("doc_id", share, 100 * n).alias("q"), F.max("doc_id").alias("top")).first()
    # Each bound is some row's id, so no range is empty and each range's largest id is its bound.
    bounds = sorted({*(at.q or []), at.top} if at.top is not None else set())
    edges = np.array(bounds, np.int64)

    def deal(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            part = np.searchsorted(edges, ids)
            last = np.flatnonzero(edges[part] == ids)
            up = (part[last] + 1) % len(edges)
            text = b.column(1)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.ones(len(ids), bool)), b.column(0), text], names=["part", "own", "doc_id", "text"])
            if len(last):
                yield pa.RecordBatch.from_arrays([pa.array(up, pa.int32()), pa.array(np.zeros(len(last), bool)), b.column(0).take(pa.array(last)), text.take(pa.array(last))], names=["part", "own", "doc_id", "text"])

    def pairs(batches):
        following = None
        for b in batches:
            for at_ in range(0, b.num_rows, 256):
                _, own, ids, texts = (c.to_pylist() for c in b.slice(at_, 256).columns)
                for o, doc_id, text in zip(own, ids, texts):
                    if o:
                        yield (None if doc_id == NO_ID else doc_id), text, following
                    following = text

    dealt = rows.mapInArrow(deal, "part int, own boolean, doc_id long, text string")
    # Rows from the range below (own = false) come first; among equal ids the largest text is the next one.
    placed = dealt.repartitionById(max(1, len(bounds)), "part").sortWithinPartitions("own", "doc_id", "text")
    return placed.mapInArrow(lambda batches: f(pairs(batches)), schema)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how much of the first the second,
    and the next document, hold.

    Null text counts as empty; texts are taken whole, however long. Rows that repeat a doc_id are
    ordered by text, and equal rows follow each other; a null doc_id comes last. A single row is
    its own next one; an empty table gives no rows. Two empty texts are alike (1), an empty and
    another are not (0). Other columns, whatever their names, are not read.
    """
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in EDITED.split(", ")]

    def run(rows):
        out, size, before = [], 0, (None, {})
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)], names=names)
        for doc_id, text, following in rows:
            cut = len(text) // 3
            edited = (text[: len(text) - cut] + following[:cut]).encode()
            own, new = chunks(text.encode()), chunks(edited)
            after = before[1] if before[0] is following else chunks(following.encode())
            before = (text, own)
            print_ = to_text(own)
            out.append((doc_id, len(text), hashlib.sha256(edited).hexdigest(), print_, to_text(new), containment(own, new), containment(own, after)))
            size += len(print_)
            if len(out) >= 1000 or size > 1 << 22:
                yield batch()
                out, size = [], 0
        yield batch()

    return with_next(docs, run, EDITED)
