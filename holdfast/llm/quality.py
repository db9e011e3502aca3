"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams of a whole text: words, word pairs, and the shapes of words and
of word pairs (runs of upper case, lower case, digits and each other byte; whether the two words are
equal) with the binary order of their share of the text. Each indicator is scaled by its class log-count
ratio, the vector is brought to length one, and a linear hinge-loss model is fitted by dual coordinate
descent (squared hinge, seeded order). A sigmoid fitted on a fifth of the sample turns margins to scores.

The model is learned from at most ``SAMPLE`` labelled rows, those of the smallest ``xxhash64(doc_id)``:
their ids are broadcast (``SAMPLE`` bounds them), their features meet in one task (bounded too), and the
model is two vectors of ``BUCKETS`` floats. Every row is scored, by its whole text, without a shuffle.

Defined cases: null and empty texts have no feature and get the score of the margin zero; labels whose
quality is null are left out; label rows that repeat count once per distinct quality; without labels of
both classes every score is 1 if no label 0 is known, else 0; a null doc_id is scored like any other, is never
a label's, and its ``held_out`` is null in the query; further columns are ignored or kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import SPACE, chunks, hash_words, mix, split_words, texts

BITS = 18
BUCKETS = 1 << BITS
SAMPLE = 12_000
THRESHOLD = 0.3
SEED = 7

_U = np.uint64
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[128:], SHAPE[48:58] = 65, 97, 97, 48


def _shares(shape: np.ndarray, text: np.ndarray, total: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each distinct shape of a text, with the order of its share."""
    values, which = np.unique(shape, return_inverse=True)
    both, count = np.unique(text * len(values) + which, return_counts=True)
    text, which = both // max(len(values), 1), both % max(len(values), 1)
    order = np.ceil(np.log2(count / np.maximum(total[text], 1)) * 0.75).astype(np.int64) + 64
    return text, mix(values[which] * _U(0x2545F4914F6CDD1D) + order.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(salt))


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of each text, ordered, and their offsets."""
    starts, ends, word_offs = split_words(data, offs, SPACE)
    h = hash_words(data, starts, ends)
    n = np.diff(word_offs)
    text = np.repeat(np.arange(len(n)), n)
    kind = SHAPE[data]
    fresh = np.ones(len(kind), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[starts] = True
    place = np.concatenate([[0], np.cumsum(fresh)])
    shape = hash_words(kind[fresh], place[starts], place[ends])
    pair = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.zeros(0, np.int64)
    same = (h[pair] == h[pair + 1]).astype(_U)
    parts = [
        (text, mix(h + _U(1))),
        (text[pair], mix(h[pair] * _U(0x9E3779B97F4A7C15) + h[pair + 1] + _U(2))),
        _shares(shape, text, n, 3),
        _shares(mix(shape[pair] * _U(0x9E3779B97F4A7C15) + shape[pair + 1] + same), text[pair], n, 4),
    ]
    key = np.unique(np.concatenate([(t << BITS) | (f >> _U(64 - BITS)).astype(np.int64) for t, f in parts]))
    return key & (BUCKETS - 1), np.searchsorted(key, np.arange(len(n) + 1) << BITS)


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])[offs])


def fit(index: np.ndarray, offs: np.ndarray, label: np.ndarray, rounds: int = 12, cost: float = 1.0, alpha: float = 1.0) -> dict:
    """The model of samples with buckets ``index[offs[i]:offs[i + 1]]`` and labels 0 or 1."""
    ones, n = int(label.sum()), len(label)
    if ones in (0, n):
        return {"constant": 0.0 if n and not ones else 1.0}
    rng = np.random.default_rng(SEED)
    held = np.zeros(n, bool)
    for c in (0, 1):
        own = rng.permutation(np.flatnonzero(label == c))
        held[own[: len(own) // 5]] = True
    y_feature = np.repeat(label, np.diff(offs))
    used = np.repeat(~held, np.diff(offs))
    p, q = (alpha + np.bincount(index[used & (y_feature == c)], minlength=BUCKETS) for c in (1, 0))
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    rows = [index[offs[i] : offs[i + 1]] for i in range(n)]
    x = [ratio[r] / max(np.sqrt((ratio[r] ** 2).sum()), 1e-9) for r in rows]
    y = 2.0 * label - 1
    weight = np.where(label == 1, n / (2.0 * ones), n / (2.0 * (n - ones))) * cost
    w, b, a = np.zeros(BUCKETS), 0.0, np.zeros(n)
    train = np.flatnonzero(~held)
    for _ in range(rounds):
        for i in rng.permutation(train):
            r, v, d = rows[i], x[i], 0.5 / weight[i]
            gradient = y[i] * (w[r] @ v + b) - 1 + d * a[i]
            new = max(0.0, a[i] - gradient / (v @ v + 1 + d))
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[r] += step * v
                b += step
                a[i] = new
    margin = np.array([w[rows[i]] @ x[i] + b for i in np.flatnonzero(held)])
    scale, shift = _sigmoid(margin, label[held])
    return {"v": (w * ratio).astype(np.float32), "r2": (ratio**2).astype(np.float32), "b": b, "scale": scale, "shift": shift}


def _sigmoid(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the sigmoid of a margin, by Newton steps on smoothed targets with a small ridge."""
    ones = max(int(label.sum()), 0)
    zeros = len(label) - ones
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x, theta = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (p - target) + 1e-3 * theta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), g)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def score(model: dict, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(offs) - 1, model["constant"])
    index, at = features(data, offs)
    size = np.sqrt(np.maximum(_sums(model["r2"][index], at), 1e-18))
    margin = _sums(model["v"][index], at) / size + model["b"]
    return 1 / (1 + np.exp(-np.clip(model["scale"] * margin + model["shift"], -30, 30)))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in chunks(b.column("text")):
            index, at = features(c.data, c.offs)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(c.first, c.rows), b.column("y").slice(c.first, c.rows), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(index.astype(np.int32)))], ["doc_id", "y", "f"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(d, y, np.asarray(f, np.int32)) for b in batches for d, y, f in zip(b.column("doc_id").to_pylist(), b.column("y").to_pylist(), b.column("f").to_numpy(zero_copy_only=False))]
    rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
    index = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.int32)
    offs = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype(np.int64)
    model = fit(index, offs, np.array([r[1] for r in rows], np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def train(docs: DataFrame, labels: DataFrame, eligible: Column | None = None, sample: int = SAMPLE) -> dict:
    """Model of ``labels(doc_id, quality)`` and the texts of ``docs``; eligible: which label rows may be used."""
    rows = labels.where("quality is not null and doc_id is not null")
    rows = rows if eligible is None else rows.where(eligible)
    ids = rows.select(F.col("doc_id").cast("long").alias("__hf_id"), (F.col("quality") > 0).cast("int").alias("y")).distinct()
    ids = ids.orderBy(F.xxhash64("__hf_id"), "__hf_id", "y").limit(sample)
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(ids), F.col("doc_id") == F.col("__hf_id")).select("doc_id", "text", "y")
    found = chosen.mapInArrow(_sampled, "doc_id long, y int, f array<int>").repartition(1).mapInArrow(_fitted, "model binary").collect()
    return pickle.loads(found[0].model) if found else {"constant": 1.0}


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row."""
    m = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(c.first, c.rows), pa.array(score(m.value, c.data, c.offs))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored under ``threshold``; every column is kept."""
    m = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [score(m.value, c.data, c.offs) for c in chunks(b.column("text"))]
            if parts:
                yield b.filter(pa.array(np.concatenate(parts) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    model = train(docs, texts(spark, sf_dir, "labels"), ~held_out())
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
