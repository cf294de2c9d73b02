"""Benchmark decontamination by spaced-seed hashing (op6).

A fixed mask hashes the words at its 1-positions and ignores the others, so a seed survives
substitutions there.  Seeds of the benchmark are joined with the seeds of the documents; around
every hit the item is laid over the document on the hit's diagonal, and every window of MIN_WORDS
words (of the whole item, if shorter) with IDENTITY equal words is an overlap.  Overlapping windows
are united to passages.

The benchmark is broadcast in blocks of about BLOCK_WORDS words (a stated bound on what a task and the
driver hold, 60 bytes a word); a larger benchmark means more passes over the documents, not more memory: with
several blocks each pass is written before the next block is collected, and its broadcast is destroyed.
Documents are never shuffled.

Words are compared without case and ASCII punctuation.  Items of fewer than MIN_ITEM words take no
part; null texts hold no word; repeated items and rows are reported each.  Wherever the tolerated
substitutions fall, one mask leaves them all out, so nothing within the rule is missed: MASKS do so in
MIN_WORDS words, and shorter items have masks of their own length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexiforge.llm.common import written
from lexiforge.llm.words import binary_column, code_points, mix64, tokens

MASKS = ("11101011", "101100111", "111111")  # one of them avoids any two of MIN_WORDS positions
MIN_WORDS = 12
IDENTITY = 0.8
MIN_ITEM = 5
BLOCK_WORDS = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def short_masks(n: int) -> list[str]:
    """Masks over a whole item of ``n`` words: it is cut into two blocks more than substitutions are
    tolerated, and each mask leaves out as many blocks as there are substitutions."""
    missing = n - math.ceil(IDENTITY * n)
    blocks = [j * (missing + 2) // n for j in range(n)]
    return ["".join("0" if b in out else "1" for b in blocks) for out in combinations(range(missing + 2), missing)]


def seeds(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash under a mask at every position where it fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.full(n, np.uint64(salt + 1), dtype=np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            h = mix64(h * _ODD + words[j:n + j])
    return h


class Index:
    """Seeds of one block of benchmark items, in sorted arrays."""

    def __init__(self, items: list[np.ndarray], masks: tuple[str, ...] = MASKS):
        self.items = items
        short = sorted({len(w) for w in items if MIN_ITEM <= len(w) < MIN_WORDS})
        self.masks = [*masks, *(m for n in short for m in short_masks(n))]
        h, item, pos = [], [], []
        for k, words in enumerate(items):
            if len(words) < MIN_ITEM:
                continue
            for salt, mask in enumerate(self.masks):
                if (len(mask) != len(words)) if salt >= len(masks) else (len(words) < MIN_WORDS):
                    continue
                s = seeds(words, mask, salt)
                h.append(s)
                item.append(np.full(len(s), k))
                pos.append(np.arange(len(s)))
        flat = np.concatenate(h) if h else np.empty(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        self.item = np.concatenate(item)[order] if h else np.empty(0, dtype=np.int64)
        self.pos = np.concatenate(pos)[order] if h else np.empty(0, dtype=np.int64)
        self.hashes, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)

    def diagonals(self, words: np.ndarray) -> np.ndarray:
        """Distinct (item, document position of the item's first word) of all hits."""
        got = []
        for salt, mask in enumerate(self.masks):
            s = seeds(words, mask, salt)
            if not len(s) or not len(self.hashes):
                continue
            at = np.searchsorted(self.hashes, s)
            at[at == len(self.hashes)] = 0
            hit = np.flatnonzero(self.hashes[at] == s)
            if len(hit):
                n = self.count[at[hit]]
                rows = np.repeat(self.first[at[hit]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                got.append(np.stack([self.item[rows], np.repeat(hit, n) - self.pos[rows]], axis=1))
        return np.unique(np.concatenate(got), axis=0) if got else np.empty((0, 2), dtype=np.int64)

    def passages(self, words: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, first word, end word, equal words) of every verified overlap."""
        found: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for k, off in self.diagonals(words).tolist():
            item = self.items[k]
            lo, hi = max(off, 0), min(off + len(item), len(words))
            need = min(MIN_WORDS, len(item))
            if hi - lo < need:
                continue
            equal = words[lo:hi] == item[lo - off:hi - off]
            total = np.concatenate([[0], np.cumsum(equal)])
            good = np.flatnonzero(total[need:] - total[:-need] >= math.ceil(IDENTITY * need))
            if len(good):
                cover = np.zeros(len(equal) + 1, dtype=np.int64)
                np.add.at(cover, good, 1)
                np.add.at(cover, good + need, -1)
                found.setdefault(k, []).append((lo, hi, np.where(np.cumsum(cover[:-1]) > 0, 1 + equal, 0).astype(np.int8)))
        out = []
        for k, parts in sorted(found.items()):
            state = np.zeros(len(words) + 2, dtype=np.int8)  # 1 covered, 2 covered and equal
            for lo, hi, s in parts:
                state[lo + 1:hi + 1] = np.maximum(state[lo + 1:hi + 1], s)
            out += [(k, a, b, n) for a, b, n in _runs(state)]
        return out


def _runs(state: np.ndarray) -> list[tuple[int, int, int]]:
    step = np.diff((state > 0).astype(np.int8))
    return [(int(a), int(b), int((state[a + 1:b + 1] == 2).sum()))
            for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]


def benchmark_blocks(bench: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, bytes]]]:
    """The items (item_id, text) in blocks of about ``block_words`` words."""
    some = bench.where("text is not null").select("item_id", "text")
    total = some.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] or 0
    n = max(1, math.ceil(total / block_words))
    for k in range(n):
        part = some if n == 1 else some.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"].encode()) for r in part.orderBy("item_id", "text").collect()]


def overlaps(docs: DataFrame, bench: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, start, end, n_words, n_equal) of every passage of ``docs`` (doc_id, text) that
    overlaps an item of ``bench`` (item_id, text); start and end in code points."""
    src = docs.select("doc_id", "text")
    schema = (f"doc_id {src.schema['doc_id'].dataType.simpleString()}, item_id {bench.schema['item_id'].dataType.simpleString()}, "
              "start long, end long, n_words int, n_equal int")

    item_type = to_arrow_type(bench.schema["item_id"].dataType)

    def one(sent) -> DataFrame:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, index = sent.value
            for batch in batches:
                rows, out = [], [[], [], [], [], []]
                for r, text in enumerate(binary_column(batch, "text")):
                    words, starts, ends = tokens(text)
                    found = index.passages(words)
                    if found:
                        at = code_points(text)
                        for k, a, b, n in found:
                            rows.append(r)
                            for col, v in zip(out, (names[k], at[starts[a]], at[ends[b - 1]], b - a, n), strict=True):
                                col.append(v)
                types = (item_type, pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]],
                                                 names=["doc_id", "item_id", "start", "end", "n_words", "n_equal"])

        return src.mapInArrow(task, schema)

    parts = []
    for items, last in _in_turn(benchmark_blocks(bench, block_words)):
        sent = src.sparkSession.sparkContext.broadcast(([i for i, _ in items], Index([tokens(t)[0] for _, t in items])))
        if last and not parts:
            return one(sent)
        parts.append(written(one(sent), "benchmark-overlaps"))
        sent.destroy()
    return reduce(DataFrame.union, parts)


def _in_turn(blocks: Iterator) -> Iterator[tuple[list, bool]]:
    """Every block, and whether it is the last one."""
    held = next(blocks)
    for block in blocks:
        yield held, False
        held = block
    yield held, True


def clean(docs: DataFrame, bench: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the rows whose text overlaps a benchmark item, other columns untouched."""
    for items, last in _in_turn(benchmark_blocks(bench, block_words)):
        sent = docs.sparkSession.sparkContext.broadcast(Index([tokens(t)[0] for _, t in items]))

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not sent.value.passages(tokens(t)[0]) for t in binary_column(batch, "text")], pa.bool_()))

        docs = docs.mapInArrow(task, docs.schema)
        if not last:
            docs = written(docs, "benchmark-clean")
            sent.destroy()
    return docs
