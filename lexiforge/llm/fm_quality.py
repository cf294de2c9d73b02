"""Quality classifier: a factorisation machine over hashed words and structure statistics (op5).

score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2]):
all pairwise interactions at a cost linear in the number of features.  Features are the words
of the text hashed to BUCKETS (log counts, unit length) and STATS statistics of its
structure, standardised on the training rows.

It is fitted by AdaGrad on at most ``max_train_rows`` labelled rows, those with the least hash of
their id (a stated bound: the fit runs on the driver over that many feature vectors).  Scoring
covers every whole text.  Defined results: null text counts as empty and gets a score; labels
that are null or of rows without a document teach nothing; without any label the score is 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import crc_of
from lexiforge.llm.words import LOWER, binary_column, word_bounds, word_hashes

BUCKETS = 1 << 16
RANK = 8
MAX_TRAIN_ROWS = 6000
EPOCHS = 6
THRESHOLD = 0.3

_CLASS = np.zeros(256, dtype=np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 sentence mark, 7 symbol
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[10] = 5
for _c in b".,;:?'\"()-":
    _CLASS[_c] = 6
for _c in b"!#$%&*+/<=>@[\\]^_`{|}~":
    _CLASS[_c] = 7
_CLASS[128:] = 1
STATS = 20


def structure(raw: bytes, words: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Statistics of a text's structure; all zero for an empty text."""
    out = np.zeros(STATS)
    if not raw:
        return out
    b = np.frombuffer(raw, dtype=np.uint8)
    out[0] = math.log1p(len(b))
    out[1:9] = np.bincount(_CLASS[b], minlength=8) / len(b)
    out[9] = np.mean(b[1:] == b[:-1]) if len(b) > 1 else 0.0
    n = len(sizes)
    if n:
        out[10] = math.log1p(n)
        out[11] = sizes.mean()
        out[12] = sizes.std()
        out[13] = len(words) / n
        out[14] = counts.max() / n
        out[15] = np.mean(sizes <= 3)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    if lines:
        out[16] = len(set(lines)) / len(lines)
        out[17] = math.log1p(len(b) / len(lines))
        out[18] = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines)
        out[19] = len(max(lines, key=len)) / len(b)
    return out


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, their values, structure statistics) of one text."""
    raw = text or b""
    low = np.frombuffer(raw.translate(LOWER), dtype=np.uint8)
    starts, ends = word_bounds(low)
    words, counts = np.unique(word_hashes(low, starts, ends), return_counts=True)
    stats = structure(raw, words, counts, ends - starts)
    value = np.log1p(counts)
    norm = math.sqrt(float((value**2).sum())) or 1.0
    return (words >> np.uint64(48)).astype(np.int64), value / norm, stats


def _raw_score(model: dict, idx: np.ndarray, val: np.ndarray, stats: np.ndarray) -> float:
    """The sum-of-squares identity: linear in the number of features."""
    z = np.clip((stats - model["mean"]) / model["std"], -5, 5)
    i = np.concatenate([idx, BUCKETS + np.arange(STATS)])
    x = np.concatenate([val, z])
    vx = model["v"][i] * x[:, None]
    return float(model["w0"] + (model["w"][i] * x).sum() + 0.5 * ((vx.sum(axis=0) ** 2).sum() - (vx**2).sum()))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK,
        epochs: int = EPOCHS, rate: float = 0.05, seed: int = 7) -> dict:
    """AdaGrad on the logistic loss; deterministic for given rows in a given order."""
    rng = np.random.default_rng(seed)
    dim = BUCKETS + STATS
    y = np.asarray(labels, dtype=float)
    stats = np.array([r[2] for r in rows]).reshape(len(rows), STATS)
    some = len(rows) > 0
    prior = min(max(float(y.mean()) if some else 0.5, 1e-3), 1 - 1e-3)
    model = {"w0": math.log(prior / (1 - prior)), "w": np.zeros(dim), "v": rng.normal(0, 0.01, (dim, rank)),
             "mean": stats.mean(axis=0) if some else np.zeros(STATS),
             "std": (stats.std(axis=0) if some else np.zeros(STATS)) + 1e-6}
    if not some:
        return model
    z = np.clip((stats - model["mean"]) / model["std"], -5, 5)
    dense = BUCKETS + np.arange(STATS)
    data = [(np.concatenate([r[0], dense]), np.concatenate([r[1], z[k]])) for k, r in enumerate(rows)]
    gw, gv, g0 = np.full(dim, 1e-6), np.full((dim, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for lo in range(0, len(order), 32):
            part = order[lo:lo + 32]
            i = np.concatenate([data[k][0] for k in part])
            x = np.concatenate([data[k][1] for k in part])
            size = [len(data[k][0]) for k in part]
            first = np.cumsum(size) - size
            v = model["v"][i]
            vx = v * x[:, None]
            s = np.add.reduceat(vx, first)
            raw = (model["w0"] + np.add.reduceat(model["w"][i] * x, first)
                   + 0.5 * ((s**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), first)))
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part)
            e = np.repeat(err, size) * x
            grad_v = e[:, None] * (np.repeat(s, size, axis=0) - vx)
            u, inv = np.unique(i, return_inverse=True)
            dw = np.bincount(inv, weights=e, minlength=len(u)) + 1e-5 * model["w"][u]
            dv = np.stack([np.bincount(inv, weights=grad_v[:, f], minlength=len(u)) for f in range(rank)], axis=1)
            dv += 1e-5 * model["v"][u]
            d0 = err.sum()
            g0 += d0**2
            gw[u] += dw**2
            gv[u] += dv**2
            model["w0"] -= rate * d0 / math.sqrt(g0)
            model["w"][u] -= rate * dw / np.sqrt(gw[u])
            model["v"][u] -= rate * dv / np.sqrt(gv[u])
    return model


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> dict:
    """Fit on at most ``max_train_rows`` rows of ``labels`` (doc_id, label) joined to ``docs`` (doc_id, text)."""
    some = (labels.where("label is not null and doc_id is not null").select("doc_id", "label").distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_train_rows))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [features(t) for t in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0].astype(np.int32) for x in f], pa.list_(pa.int32())),
                 pa.array([x[1].astype(np.float32) for x in f], pa.list_(pa.float32())),
                 pa.array([x[2] for x in f], pa.list_(pa.float64()))], names=["doc_id", "label", "idx", "val", "stats"])

    rows = (docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "label", "text")
            .mapInArrow(task, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, idx array<int>, val array<float>, stats array<double>")
            .toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")]))
    lists = [rows.column(c).to_pylist() for c in ("idx", "val", "stats")]
    data = [(np.array(a, dtype=np.int64), np.array(b, dtype=np.float64), np.array(c)) for a, b, c in zip(*lists, strict=True)]
    return fit(data, np.array(rows.column("label").to_pylist(), dtype=float))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(
        {k: v.astype(np.float32) if isinstance(v, np.ndarray) and len(v) > STATS else v for k, v in model.items()})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.array([_raw_score(sent.value, *features(t)) for t in binary_column(batch, "text")])
            p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(task, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")


def held_out() -> Column:
    return crc_of("doc_id") % 5 == 0


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows that are not held out and score every document."""
    model = train(docs, labels.where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("label")))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
