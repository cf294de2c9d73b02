"""Language identification by rank-order n-gram profiles (op4).

A language's profile is its ``top`` most frequent character n-grams (n = 1..3, word ends
marked) in rank order, counted over all training texts.  A document is compared by the
out-of-place distance between its own ``top`` most frequent n-grams and every profile.

Defined results: a null text or one without a letter gives ``und`` with score 0; ties between
languages go to the lesser name, ties between n-grams to the lesser code; without any training
row every document is ``und``; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import crc_of
from lexiforge.llm.words import binary_column

UND = "und"
TOP = 300
MAX_LANGUAGES = 5000  # profiles are broadcast: at most MAX_LANGUAGES * TOP ranks of 12 bytes
_HELD = 2_000_000  # n-grams that a training task holds before it hands them on
_SEP = 0x20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def ngram_codes(text: bytes | None) -> np.ndarray:
    """Codes of all 1- to 3-grams inside the lower-cased words of a text (repeats kept)."""
    if not text:
        return np.empty(0, dtype=np.int64)
    cps = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letters()[cps]
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    c = np.full(len(cps) + 2, _SEP, dtype=np.int64)
    c[1:-1] = np.where(letter, cps, _SEP)
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != _SEP) | (c[:-1] != _SEP)
    c = c[keep]
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[c[1:-1] != _SEP]
    return np.concatenate([c[c != _SEP], two, three])


def ranked(text: bytes | None, top: int) -> np.ndarray:
    """The most frequent n-grams of a text in rank order."""
    codes, n = np.unique(ngram_codes(text), return_counts=True)
    return codes[np.argsort(-n, kind="stable")[:top]]


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> pa.RecordBatch:
        langs = np.concatenate([np.full(len(c), k, dtype=object) for k, (c, _) in held.items()])
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(np.concatenate([c for c, _ in held.values()]), pa.int64()),
             pa.array(np.concatenate([n for _, n in held.values()]), pa.int64())], ["lang", "gram", "n"])

    def add(lang: str, parts: list[np.ndarray]) -> None:
        codes, n = np.unique(np.concatenate(parts), return_counts=True)
        if lang in held:
            c0, n0 = held[lang]
            codes, inv = np.unique(np.concatenate([c0, codes]), return_inverse=True)
            n = np.bincount(inv, weights=np.concatenate([n0, n])).astype(np.int64)
        held[lang] = (codes, n)

    for batch in batches:
        wait: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        for lang, text in zip(batch.column(batch.schema.get_field_index("lang")).to_pylist(),
                              binary_column(batch, "text"), strict=True):
            codes = ngram_codes(text)
            wait.setdefault(lang, []).append(codes)
            sizes[lang] = sizes.get(lang, 0) + len(codes)
            if sizes[lang] > _HELD:
                add(lang, wait.pop(lang))
                sizes.pop(lang)
        for lang, parts in wait.items():
            add(lang, parts)
        if sum(len(c) for c, _ in held.values()) > _HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def train(docs: DataFrame, top: int = TOP) -> dict[str, np.ndarray]:
    """Rank-order profiles of every non-null ``lang`` of ``docs`` (text, lang), counted over all rows."""
    grams = (docs.where(F.col("lang").isNotNull()).select("lang", "text")
             .mapInArrow(_count_task, "lang string, gram long, n long")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    w = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    rows = grams.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    got = rows.select("lang", "r", "gram").limit(MAX_LANGUAGES * top + 1).collect()
    if len(got) > MAX_LANGUAGES * top:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    profiles: dict[str, list] = {}
    for lang, r, gram in got:
        profiles.setdefault(lang, []).append((r, gram))
    return {k: np.array([g for _, g in sorted(v)], dtype=np.int64) for k, v in sorted(profiles.items())}


class _Scorer:
    """All profiles in one table of ranks; shipped to the tasks as a broadcast."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int):
        self.top, self.names = top, sorted(profiles)
        flat = np.concatenate([np.empty(0, dtype=np.int64), *[profiles[k] for k in self.names]])
        self.grams, inv = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(self.names)), [len(profiles[k]) for k in self.names])
        rank = np.concatenate([np.empty(0, dtype=np.int64), *[np.arange(len(profiles[k])) for k in self.names]])
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, dtype=np.int32)  # the last row: no such n-gram
        self.ranks[inv, owner] = rank

    def __call__(self, text: bytes | None) -> tuple[str, float]:
        mine = ranked(text, self.top)
        if not len(mine) or not self.names:
            return UND, 0.0
        at = np.searchsorted(self.grams, mine)
        at[at == len(self.grams)] = 0
        at[self.grams[at] != mine] = len(self.grams)
        r = self.ranks[at]
        far = np.where(r < 0, self.top, np.abs(r - np.arange(len(mine))[:, None])).sum(axis=0)
        best = int(np.argmin(far))
        return self.names[best], float(1.0 - far[best] / (self.top * len(mine)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; score is 1 - distance / worst distance."""
    scorer = docs.sparkSession.sparkContext.broadcast(_Scorer(profiles, top))
    src = docs.select("doc_id", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scorer.value(t) for t in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(task, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: dict[str, np.ndarray], least: float = 0.1, top: int = TOP) -> DataFrame:
    """``docs`` without the rows of no language: ``und``, or a score below ``least``."""
    scorer = docs.sparkSession.sparkContext.broadcast(_Scorer(profiles, top))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scorer.value(t) for t in binary_column(batch, "text")]
            yield batch.filter(pa.array([lang != UND and score >= least for lang, score in got], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def held_out() -> Column:
    return crc_of("doc_id") % 3 == 1


def predict(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out and predict every row: (doc_id, held_out, lang_pred, score)."""
    profiles = train(docs.where(~held_out()).select("text", "lang"))
    return (identify(docs, profiles)
            .select("doc_id", held_out().alias("held_out"), "lang_pred", "score"))
