"""Quality rules: counted base rules, then a trained verdict.

The verdict is a logistic regression over hashed character pairs and four-grams, words and
word pairs. It is fitted on labelled rows, its margin is calibrated on rows that the fit did not
see, and texts are scored in Arrow batches against a fixed probability.
"""

from __future__ import annotations

import contextlib
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches, text_or_empty
from .tokens import release, trim


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: Texts whose calibrated probability of good quality is below this are rejected.
    threshold: float = 0.4
    #: Hashed features.
    dimensions: int = 1 << 12
    #: Labelled rows used for the fit, those with the smallest hash of their id; a third of them calibrates.
    sample: int = 3000
    steps: int = 80


SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    #: Calibration: probability = sigmoid(slope * margin + shift).
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, x: np.ndarray) -> float:
        z = self.slope * (float(x @ self.weights) + self.bias) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def numbered(words: list) -> tuple[np.ndarray, np.ndarray]:
    """Each word's number, and a hash of each distinct word in order of number."""
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return ids, np.fromiter(map(zlib.crc32, seen), np.uint32, len(seen))


def repeated_words(ids: np.ndarray, window: int = 5) -> int:
    """Words that lie in some window found twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    span = int(ids.max()) + 1
    code = ids[:n]
    for k in range(1, window):
        # Renumbered after every step, so a code never overflows and equal codes mean equal windows.
        if len(np.unique(code)) == n:
            return 0
        code = np.unique(code * span + ids[k : k + n], return_inverse=True)[1]
    found = np.bincount(code)[code] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += found
    edge[window:] -= found
    return int((np.cumsum(edge)[:-1] > 0).sum())


def features(data: bytes, ids: np.ndarray, hashes: np.ndarray, dimensions: int) -> np.ndarray:
    """Square roots of the shares that character pairs and four-grams, words and word pairs have."""
    out = np.zeros(dimensions, np.float32)
    mask = np.uint64(dimensions - 1)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    kinds = []
    if len(b) > 1:
        kinds.append(((b[:-1] | b[1:] << 8) * np.uint32(2246822519) >> np.uint32(13)) & np.uint32(mask))
    if len(b) > 3:
        kinds.append(((b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24) * np.uint32(2654435761) >> np.uint32(16)) & np.uint32(mask))
    if len(ids):
        h = hashes[ids].astype(np.uint64)
        kinds.append((h >> np.uint64(7)) & mask)
        if len(h) > 1:
            same = h[1:] == h[:-1]  # a word that repeats the one before is one feature, whatever the word
            kinds.append(np.where(same, np.uint64(11), (h[:-1] * np.uint64(31) + h[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & mask)
    for k in kinds:
        out += np.bincount(k.astype(np.int64), minlength=dimensions).astype(np.float32) / len(k)
    return np.sqrt(out)


def measure(text: str, rules: Rules) -> tuple[tuple, np.ndarray, bytes, np.ndarray]:
    data = text.encode("utf-8")
    words = data.split()
    ids, hashes = numbered(words)
    lines = Counter(x for x in data.split(b"\n") if x.split())
    n, repeat = len(words), repeated_words(ids)
    chars = len(b"".join(words).decode("utf-8"))
    counts = (n, chars, sum(map(text.count, SYMBOLS)), lines.total() - len(lines), repeat)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
    return (*counts, failed), ids, data, hashes


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, rules: Rules = Rules()) -> Model:
    """Logistic regression by Adam with both classes weighted alike, then Platt scaling on every third row."""
    held = np.arange(len(y)) % 3 == 2
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        raise ValueError("labelled rows of both classes are needed")
    a, b = x[~held].astype(np.float32), y[~held].astype(np.float32)
    per = np.where(b == 1, 0.5 / (b == 1).sum(), 0.5 / (b == 0).sum()).astype(np.float32)
    w, bias = np.zeros(x.shape[1], np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rules.steps + 1):
        e = (_sigmoid(a @ w + bias) - b) * per
        g, gb = a.T @ e + 1e-5 * w, float(e.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    z, t = (x[held].astype(np.float32) @ w + bias).astype(float), y[held]
    # Platt's targets keep the scale finite where classes separate.
    good, bad = (t == 1).sum(), (t == 0).sum()
    t = np.where(t == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(slope * z + shift)
        d = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - t) * z).sum(), (p - t).sum()])
        hess = np.array([[(d * z * z).sum() + 1e-6, (d * z).sum()], [(d * z).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        slope, shift = slope - step[0], shift - step[1]
        if abs(step).max() < 1e-8:
            break
    return Model(w, float(bias), float(max(slope, 1e-3)), float(shift))


def labelled_features(docs: DataFrame, labels: DataFrame, rules: Rules) -> DataFrame:
    """id, quality and x (features at half precision) of at most `rules.sample` labelled ids; conflicting labels count as bad.

    Of rows that repeat an id the text with the smallest hash is taken, so the fit depends neither
    on the order of rows nor on how often one repeats."""
    small_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(rules.sample)

    def run(batches):
        release()
        for b in sliced(batches, 512):
            ids, quality, texts = (c.to_pylist() for c in b.columns)
            made = []
            for t in texts:
                _, numbers, data, hashes = measure(t, rules)
                made.append(features(data, numbers, hashes, rules.dimensions).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(quality, pa.int32()), pa.array(made, pa.binary())], names=["id", "quality", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text")).join(F.broadcast(known), "id")
    rows = rows.groupBy("id").agg(F.min_by(F.struct("quality", "text"), F.struct(F.xxhash64("text"), "text")).alias("one")).select("id", "one.quality", "one.text")
    return rows.select("id", F.col("quality").cast("int"), "text").mapInArrow(run, "id long, quality int, x binary")


def fit(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> Model | None:
    """A model fitted on the labelled rows; None where labels of both classes are too few to fit and calibrate.

    Null text counts as empty, labels without an id or a quality are left out, and texts are taken
    whole, however long. Without documents or labels there is no model. Columns other than
    doc_id, text and quality are not read. The result depends on the set of rows only. One task
    trains, on `rules.sample` rows at most, and only the model goes to the driver.
    """

    def run(batches):
        ids, y, x = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty((0, rules.dimensions), np.float16)]
        for b in batches:
            ids.append(b.column(0).to_numpy())
            y.append(b.column(1).to_numpy())
            x.append(np.frombuffer(b"".join(b.column(2).to_pylist()), np.float16).reshape(-1, rules.dimensions))
        order = np.argsort(np.concatenate(ids))
        with contextlib.suppress(ValueError):
            m = train(np.concatenate(x)[order], np.concatenate(y)[order], rules)
            yield pa.RecordBatch.from_pydict({"weights": [m.weights.astype(np.float64).tobytes()], "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})
        x.clear()
        trim()

    made = labelled_features(docs, labels, rules).repartition(1).mapInArrow(run, "weights binary, bias double, slope double, shift double").collect()
    return Model(np.frombuffer(made[0].weights, np.float64), made[0].bias, made[0].slope, made[0].shift) if made else None


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def score(docs: DataFrame, model: Model | None, rules: Rules = Rules(), keep_columns: bool = False) -> DataFrame:
    """doc_id and the verdict's columns for every row, or all columns of `docs` and `kept`.

    Null or empty text has no words and fails the base rule; texts are read whole, however long.
    Rows that repeat a doc_id are judged each, alike if their texts are; a null one stays null.
    A probability equal to the threshold is enough. Without a model the base rules alone decide.
    An empty table gives no rows. Other columns, whatever their names, are not read (or pass
    through unchanged with `keep_columns`).
    """
    types = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64()]
    names = [x.split()[0] for x in VERDICT.split(", ")]
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def verdicts(texts: list[str | None]):
        m, rows = shared.value, []
        for t in texts:
            counts, ids, data, hashes = measure(t or "", rules)
            p = 1.0 if m is None else 0.0 if not ids.size else m.probability(features(data, ids, hashes, rules.dimensions))
            rows.append((*counts, not counts[-1] and p >= rules.threshold, p))
        return [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)]

    def run(batches):
        release()
        for part in sliced(batches, 512):
            yield pa.RecordBatch.from_arrays([part.column(0), *verdicts(part.column(1).to_pylist())], names=["doc_id", *names])

    def keep(batches):
        release()
        for b in sliced(batches, 512):
            yield b.filter(verdicts(b.column(b.schema.get_field_index("text")).to_pylist())[6])

    if keep_columns:
        return docs.mapInArrow(keep, docs.schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + VERDICT)
