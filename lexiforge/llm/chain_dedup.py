"""Substring dedup by collinear chaining of shared seeds (op9): finds fuzzy repeated passages.

1. Seeds: hashes of SEED words at the minimizers of every window of WINDOW seeds, so two texts with
   SEED + WINDOW - 1 equal words in a row share one.
2. Every seed that occurs more than once is joined to its least occurrence (text key, position): a
   repeated passage costs one row per occurrence and seed, never a pair of all occurrences.
   Where a seed is frequent, its least occurrence may share nothing else.  So the runs of up to RUN
   repeated seeds that begin at every repeated seed are sorted, and neighbours in that order are
   linked too: one of them shares the longest run that any other occurrence shares.
3. The matches of two texts are chained: a chain ascends in both, scores SEED per match less GAP_COST
   per skipped word in either text, and is found exactly with a Fenwick tree of prefix maxima.  Chains
   are cut at gaps of more than MAX_GAP words.
4. Chains are aligned: the words between two matches by edit distance, the ends word by word.
   Passages of MIN_WORDS words and IDENTITY or more are reported.

Texts travel compressed, only the chain's slice of the first text to the second.  Words are compared
without case and ASCII punctuation.  Rows that agree in id and text are one text; a text may repeat
itself; null and short texts have no seeds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import written
from lexiforge.llm.words import binary_column, code_points, many_tokens, pieces, shingle_hashes, whole_keys

SEED = 6
WINDOW = 16
RUN = 16  # seeds of a run; longer ones count as equal when so many are
GAP_COST = 0.1
MAX_GAP = 30
MIN_WORDS = 40
IDENTITY = 0.8
MIN_SPAN = 15  # words that a chain spans before it is aligned
MARGIN = 60  # words beyond a chain's ends that an alignment may use
AT_ONCE = 1 << 17  # bytes of texts that are taken apart together, or one text
_LOW = np.uint64((1 << 20) - 1)


def minimizers(words: np.ndarray, k: int = SEED, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the seeds that are least in some window (leftmost on ties)."""
    if len(words) < k:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    h = shingle_hashes(words, k)
    picked = []
    piece = int(_LOW) - window  # positions are packed below the hash, piece by piece
    for lo in range(0, len(h), piece):
        part = h[lo:lo + piece + window - 1]
        v = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        w = min(window, len(v))
        picked.append(lo + np.unique(np.lib.stride_tricks.sliding_window_view(v, w).min(axis=1) & _LOW).astype(np.int64))
    at = np.unique(np.concatenate(picked))
    return at, h[at]


def text_minimizers(words: np.ndarray, first: np.ndarray, k: int = SEED, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`minimizers` of texts whose words follow one another: (text, position, hash).  ``first``: the first
    word of each text, and the number of words."""
    sizes = np.diff(first)
    if len(sizes) == 1 or len(words) >= int(_LOW) - window:
        got = [minimizers(words[lo:hi], k, window) for lo, hi in pairwise(first.tolist())]
        return np.repeat(np.arange(len(got)), [len(p) for p, _ in got]), np.concatenate([p for p, _ in got]), np.concatenate([h for _, h in got])
    n = np.maximum(sizes - k + 1, 0)  # seeds
    if not n.any():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    text, begin = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    pos = np.arange(len(text)) - begin[text]
    h = shingle_hashes(words, k)[first[text] + pos]
    v = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    low, width = v, 1
    while width < min(window, len(v)):  # the least of ``width`` seeds in a row
        step = min(width, window - width, len(v) - width)
        low, width = np.minimum(low[:-step], low[step:]), width + step
    picked = [low[text[:len(low)] == text[width - 1:]]] if width == window else []
    some = n > 0
    picked.append(np.minimum.reduceat(v, begin[some])[n[some] < window])  # texts of less than a window
    at = np.unique(np.concatenate(picked) & _LOW).astype(np.int64)
    return text[at], pos[at], h[at]


def chain(x: list[int], y: list[int], weight: float = SEED, cost: float = GAP_COST) -> tuple[list[float], list[int]]:
    """Best chain score that ends in every match and its predecessor (-1: none).

    A match may follow another that is smaller in x and in y; the gap costs ``cost`` per word skipped
    in x and in y.  Adding cost * (x + y) makes that a prefix maximum over y: a Fenwick tree, O(n log n).
    """
    order = sorted(range(len(x)), key=lambda i: (x[i], -y[i]))
    ranks = sorted(set(y))
    best, who = [float("-inf")] * (len(ranks) + 1), [-1] * (len(ranks) + 1)
    score, back = [0.0] * len(x), [-1] * len(x)
    for i in order:
        at = r = bisect_left(ranks, y[i])  # ranks below y[i] are 1..r of the tree
        top, prev = float("-inf"), -1
        while r > 0:
            if best[r] > top:
                top, prev = best[r], who[r]
            r -= r & -r
        lift = cost * (x[i] + y[i])
        gain = top - lift
        score[i] = weight + max(gain, 0.0)
        back[i] = prev if gain > 0 else -1
        r = at + 1
        while r <= len(ranks):
            if score[i] + lift > best[r]:
                best[r], who[r] = score[i] + lift, i
            r += r & -r
    return score, back


def chains(x: list[int], y: list[int], max_gap: int = MAX_GAP, min_span: int = MIN_SPAN) -> list[list[int]]:
    """Disjoint chains, best first, cut at gaps over ``max_gap`` words."""
    score, back = chain(x, y)
    used, out = [False] * len(x), []
    for end in sorted(range(len(x)), key=lambda i: -score[i]):
        path, i = [], end
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = back[i]
        path.reverse()
        part: list[int] = []
        for i in path:
            if part and max(x[i] - x[part[-1]], y[i] - y[part[-1]]) > max_gap + SEED:
                out.append(part)
                part = []
            part.append(i)
        out.append(part)
    return [p for p in out if p and len(p) > 1 and x[p[-1]] + SEED - x[p[0]] >= min_span]


def expanded(key: np.ndarray, pos: np.ndarray, other_pos: np.ndarray, gaps: list[bytes], other_gaps: list[bytes],
             same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matches (key, x, y) of rows that hold the first of some and the words from each to the next, sorted
    and each once; of a text with itself (``same``) those with x > y."""
    n = np.array([len(g) for g in gaps], dtype=np.int64) + 1
    start = np.cumsum(n) - n

    def places(first: np.ndarray, steps: list[bytes]) -> np.ndarray:
        flat = np.empty(int(n.sum()), dtype=np.int64)
        inside = np.ones(len(flat), dtype=bool)
        inside[start] = False
        flat[start], flat[inside] = first, np.frombuffer(b"".join(steps), dtype=np.uint8)
        total = np.cumsum(flat)
        return total - np.repeat(total[start] - first, n)

    x, y, key = places(pos, gaps), places(other_pos, other_gaps), np.repeat(key, n)
    keep = ~np.repeat(same, n) | (x > y)
    x, y, key = x[keep], y[keep], key[keep]
    if not len(x):
        return key, x, y
    xs, ys = int(x.max()).bit_length(), int(y.max()).bit_length()
    if int(key.max()).bit_length() + xs + ys < 64:
        u = np.unique((key << (xs + ys)) | (x << ys) | y)
        return u >> (xs + ys), (u >> ys) & ((1 << xs) - 1), u & ((1 << ys) - 1)
    order = np.lexsort((y, x, key))
    x, y, key = x[order], y[order], key[order]
    keep = np.concatenate([[True], (np.diff(x) != 0) | (np.diff(y) != 0) | (np.diff(key) != 0)])
    return key[keep], x[keep], y[keep]


def all_chains(key: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`chains` of every key (matches sorted by key, x, y): the matches, chain by chain, and the sizes of the chains.

    Where x and y both ascend from match to match, each match follows the one before it.  If also no step costs
    as much as a match gains, unless chains are cut there, the chains are what lies between the cuts.
    """
    if not len(x):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    new = np.concatenate([[True], np.diff(key) != 0])
    dx, dy = np.diff(x, prepend=x[:1]), np.diff(y, prepend=y[:1])
    far = np.maximum(dx, dy) > MAX_GAP + SEED
    plain = new | ((dx > 0) & (dy > 0) & (far | (GAP_COST * (dx + dy + 1) < SEED)))
    first = np.flatnonzero(new)
    simple = np.logical_and.reduceat(plain, first)
    begin = np.flatnonzero(new | far)
    size = np.diff(begin, append=len(x))
    ok = simple[(np.cumsum(new) - 1)[begin]] & (size > 1) & (x[begin + size - 1] + SEED - x[begin] >= MIN_SPAN)
    at = [np.flatnonzero(np.repeat(ok, size))]
    sizes = [size[ok]]
    last = np.append(first[1:], len(x))
    for lo, hi in zip(first[~simple].tolist(), last[~simple].tolist(), strict=True):
        found = chains(x[lo:hi].tolist(), y[lo:hi].tolist())
        at += [np.array(c) + lo for c in found]
        sizes.append(np.array([len(c) for c in found], dtype=np.int64))
    return np.concatenate(at), np.concatenate(sizes)


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    row = np.arange(len(b) + 1)
    ramp = np.arange(len(b) + 1)
    for w in a:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[:-1] + (b != w), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row[-1])


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Words to go on with, and how many of them differ: up to the last equal word while five
    words hold four equal ones."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    if same.all():
        return n, 0
    run = np.concatenate([[0], np.cumsum(~same)])
    bad = np.flatnonzero(run[np.minimum(np.arange(n) + 5, n)] - run[np.arange(n)] > 1)
    stop = int(bad[0]) if len(bad) else n
    stop += int(np.argmin(same[stop:])) if stop < n and same[stop] and not same[stop:].all() else 0
    good = np.flatnonzero(same[:stop])
    stop = int(good[-1]) + 1 if len(good) else 0
    return stop, int((~same[:stop]).sum())


def align(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int], k: int = SEED) -> tuple[int, int, int, int, int]:
    """Align along a chain: (start in a, end in a, start in b, end in b, differing words)."""
    miss = 0
    steps = range(len(x) - 1)
    if x[-1] - x[0] == y[-1] - y[0] and all(q - p == y[0] - x[0] for p, q in zip(x, y, strict=True)):
        differ = np.flatnonzero(a[x[0]:x[-1]] != b[y[0]:y[-1]]) + x[0]
        steps = np.unique(np.searchsorted(x, differ, side="right") - 1).tolist() if len(differ) else ()
    for i in steps:
        p, q = a[x[i]:x[i + 1]], b[y[i]:y[i + 1]]
        if len(p) != len(q) or not np.array_equal(p, q):
            miss += edit_distance(p, q)
    left, m0 = _extend(a[:x[0]][::-1], b[:y[0]][::-1])
    right, m1 = _extend(a[x[-1] + k:], b[y[-1] + k:])
    return x[0] - left, x[-1] + k + right, y[0] - left, y[-1] + k + right, miss + m0 + m1


def _link(p: tuple, q: tuple) -> tuple | None:
    """(at, other, pos, other_pos, gaps, other_gaps) of two neighbouring runs that share two seeds or more."""
    n = next((i for i in range(0, min(len(p[0]), len(q[0])), 4) if p[0][i:i + 4] != q[0][i:i + 4]), min(len(p[0]), len(q[0]))) // 4
    if n < 2:
        return None
    a, b = (p, q) if p[1:3] > q[1:3] else (q, p)
    return a[1], b[1], a[2], b[2], a[3][:n - 1], b[3][:n - 1]


def neighbours(repeated: DataFrame) -> DataFrame:
    """Links (at, other, pos, other_pos, gaps, other_gaps) of each run of repeated seeds (at, pos, seed, n)
    to its neighbours in the order of runs; gaps are the words from each shared seed to the next."""
    spark = repeated.sparkSession

    def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in whole_keys(batches, ["at"]):
            at, pos, seed, n = (t.column(c).to_numpy() for c in ("at", "pos", "seed", "n"))
            where = np.concatenate([[True], pos[1:] != pos[:-1]])  # equal rows are one text
            where[first] = True
            at, pos, seed, n = at[where], pos[where], seed[where].astype(">i8").view(np.uint8).reshape(-1, 8)[:, :4].tobytes(), n[where]
            often = np.concatenate([[0], np.cumsum(n > 2)])
            gap = np.diff(pos)
            steps = np.clip(gap, 0, 255).astype(np.uint8).tobytes()
            here = np.arange(len(pos))
            breaks = np.append(np.flatnonzero((gap > WINDOW) | (at[1:] != at[:-1])), len(pos) - 1)
            stop = np.minimum(breaks[np.searchsorted(breaks, here)] + 1, here + RUN)
            # the pairs of seeds that occur twice only are matches already
            keep = np.flatnonzero((stop - here > 1) & (often[stop] > often[here]))
            ends = list(zip(keep.tolist(), stop[keep].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([seed[4 * i:4 * j] for i, j in ends], pa.binary()), pa.array(at[keep], pa.int64()),
                 pa.array(pos[keep], pa.int32()), pa.array([steps[i:j - 1] for i, j in ends], pa.binary())], names=["run", "at", "pos", "gaps"])

    runs = written(repeated.select("at", "pos", "seed", "n").repartition("at").sortWithinPartitions("at", "pos")
                   .mapInArrow(run_rows, "run binary, at long, pos int, gaps binary"), "chain-runs")

    def link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within a slice; its first and last run come as rows with ``edge``, to be linked across slices."""
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                yield _links([_edge(tuple(c[0].as_py() for c in batch.columns))])
            else:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            run, gaps = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            at, pos = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            there = np.arange(RUN) < np.array([len(r) // 4 for r in run])[:, None]
            seeds = np.zeros(there.shape, dtype=np.uint32)
            seeds[there] = np.frombuffer(b"".join(run), dtype=np.uint32)
            differ = (seeds[1:] != seeds[:-1]) | ~there[1:] | ~there[:-1]
            shared = np.where(differ.any(axis=1), differ.argmax(axis=1), RUN)
            hit = np.flatnonzero(shared >= 2)
            later = (at[hit] > at[hit + 1]) | ((at[hit] == at[hit + 1]) & (pos[hit] > pos[hit + 1]))
            a, b, n = np.where(later, hit, hit + 1), np.where(later, hit + 1, hit), (shared[hit] - 1).tolist()
            yield _link_batch([at[a], at[b], pos[a], pos[b], [gaps[i][:m] for i, m in zip(a.tolist(), n, strict=True)],
                               [gaps[i][:m] for i, m in zip(b.tolist(), n, strict=True)], [None] * len(n)])
            last = batch.slice(batch.num_rows - 1)
        if last is not None:
            yield _links([_edge(tuple(c[0].as_py() for c in last.columns))])

    linked = written(runs.repartitionByRange("run", "at", "pos").sortWithinPartitions("run", "at", "pos")
                     .mapInArrow(link_rows, f"{_LINK}, edge binary"), "chain-neighbours")
    ends = [(bytes(r["edge"]), r["at"], r["pos"], bytes(r["gaps"])) for r in linked.where("edge is not null").collect()]  # two a slice
    ends.sort()
    across = [x for p, q in zip(ends[:-1], ends[1:], strict=True) if p != q and (x := _link(p, q))]
    return linked.where("edge is null").drop("edge").union(spark.createDataFrame(across, _LINK))


_LINK = "at long, other long, pos int, other_pos int, gaps binary, other_gaps binary"


def _edge(run: tuple) -> tuple:
    return run[1], None, run[2], None, run[3], None, run[0]


def _links(rows: list[tuple]) -> pa.RecordBatch:
    return _link_batch([[r[i] for r in rows] for i in range(7)])


def _link_batch(columns: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                      names=["at", "other", "pos", "other_pos", "gaps", "other_gaps", "edge"])


def _unpacked(packed: list[bytes], slices: list[bytes] | None = None) -> Iterator[tuple[int, list[bytes], list[int], list[bytes]]]:
    """Rows in turn, as many as hold about AT_ONCE bytes: the first of them, their texts (one for rows in a row
    with the same), the text of each row, and their slices."""
    z = zstandard.ZstdDecompressor()
    texts, which, parts, lo, held = [], [], [], 0, 0
    last = raw = None
    for i, p in enumerate(packed):
        if held >= AT_ONCE:
            yield lo, texts, which, parts
            texts, which, parts, lo, held = [], [], [], i, 0
        if p != last:
            last, raw = p, z.decompress(p)
            held += len(raw)
        if not texts or texts[-1] is not raw:
            texts.append(raw)
        which.append(len(texts) - 1)
        if slices is not None:
            parts.append(z.decompress(slices[i]))
            held += len(parts[-1])
    if which:
        yield lo, texts, which, parts


class _Words:
    """Texts taken apart: the words and their offsets, in code points as well."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.words, self.starts, self.ends, begins, first = many_tokens(texts)
        self.chars = code_points(b"\n".join(texts))
        self.begins, self.first = begins.tolist(), first.tolist()

    def holds(self, texts: list[bytes]) -> bool:
        return len(texts) == len(self.texts) == 1 and texts[0] is self.texts[0]

    def of(self, text: int) -> np.ndarray:
        return self.words[self.first[text]:self.first[text + 1]]

    def span(self, text: int, start: int, end: int) -> tuple[int, int]:
        """Byte offsets in the text of the words from ``start`` up to ``end``."""
        at, begin = self.first[text], self.begins[text]
        return int(self.starts[at + start]) - begin, int(self.ends[at + end - 1]) - begin

    def points(self, text: int, start: int, end: int) -> tuple[int, int]:
        """The same in code points."""
        lo, hi = self.span(text, start, end)
        begin = self.begins[text]
        return int(self.chars[begin + lo] - self.chars[begin]), int(self.chars[begin + hi] - self.chars[begin])


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """(doc_id, start, end, other_id, other_start, other_end, n_words, identity): passages of ``docs``
    (doc_id, text) that repeat, exactly or nearly, an earlier occurrence; offsets in code points."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select(F.xxhash64("doc_id", "text").alias("at"), "doc_id", "text").where("text is not null")

    def seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), binary_column(batch, "text")
            for lo, hi in pieces([len(t) for t in texts], AT_ONCE):
                words, _, _, _, first = many_tokens(texts[lo:hi])
                which, pos, seed = text_minimizers(words, first)
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo:hi][which]), pa.array(seed.astype(np.int64)), pa.array(pos.astype(np.int32))],
                                                 names=["at", "seed", "pos"])

    seeds = src.select("at", "text").mapInArrow(seed_rows, "at long, seed long, pos int")
    first = (seeds.groupBy("seed").agg(F.count("*").alias("n"), F.min(F.struct("at", "pos")).alias("o"))
             .where("n > 1").select("seed", "n", F.col("o.at").alias("other"), F.col("o.pos").alias("other_pos")))
    repeated = written(seeds.join(written(first, "chain-seeds"), "seed"), "chain-repeated")
    matches = (repeated.where("at <> other or pos <> other_pos").select("at", "other", "pos", "other_pos")
               .withColumns({"gaps": F.lit(b""), "other_gaps": F.lit(b"")}).union(neighbours(repeated)))

    def chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in whole_keys(batches, ["at", "other"]):
            at, other = t.column("at").to_numpy(), t.column("other").to_numpy()
            key = np.repeat(np.arange(len(first)), np.diff(first, append=t.num_rows))
            places = (t.column(c).to_numpy().astype(np.int64) for c in ("pos", "other_pos"))
            key, x, y = expanded(key, *places, t.column("gaps").to_pylist(), t.column("other_gaps").to_pylist(), at == other)
            found, sizes = all_chains(key, x, y)
            if len(sizes):
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                row = first[key[found[np.cumsum(sizes) - sizes]]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[row]), pa.array(other[row]), *(pa.ListArray.from_arrays(ends, pa.array(v[found], pa.int32())) for v in (x, y))],
                    names=["at", "other", "xs", "ys"])

    linked = written(matches.repartition("at", "other").sortWithinPartitions("at", "other", "pos")
                     .mapInArrow(chain_rows, "at long, other long, xs array<int>, ys array<int>"), "chain-links")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([z.compress(t) for t in binary_column(batch, "text")], pa.binary())],
                                             names=["at", "doc_id", "packed"])

    texts = src.mapInArrow(packed, f"at long, doc_id {kind}, packed binary")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out, xs, spans = [], batch.column(2).to_pylist(), []
            for lo, texts, which, _ in _unpacked(batch.column(5).to_pylist()):
                words = _Words(texts)
                for x, w in zip(xs[lo:lo + len(which)], which, strict=True):
                    a, b = max(0, x[0] - MARGIN), min(words.first[w + 1] - words.first[w], x[-1] + SEED + MARGIN)
                    start, end = words.span(w, a, b)
                    out.append((c.compress(texts[w][start:end]), words.points(w, a, b)[0]))
                    spans.append([v - a for v in x])
            xs = spans
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(4), pa.array(xs, pa.list_(pa.int32())), batch.column(3),
                 pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64())],
                names=["other", "doc_id", "xs", "ys", "slice", "shift"])

    cut = (linked.join(texts, "at").select("at", "other", "xs", "ys", "doc_id", "packed")
           .mapInArrow(slices, f"other long, doc_id {kind}, xs array<int>, ys array<int>, slice binary, shift long"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_of = None
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n not in ("doc_id", "other_id")}
            rows, out = [], [[] for _ in range(6)]
            for lo, texts, which, parts in _unpacked(cols["packed"], cols["slice"]):
                if texts_of is None or not texts_of.holds(texts):
                    texts_of = _Words(texts)
                slices_of = _Words(parts)
                for i, w in enumerate(which):
                    r = lo + i
                    a0, a1, b0, b1, miss = align(slices_of.of(i), texts_of.of(w), cols["xs"][r], cols["ys"][r])
                    n = max(a1 - a0, b1 - b0)
                    if n >= min_words and miss <= (1 - identity) * n:
                        rows.append(r)
                        start, end = (p + cols["shift"][r] for p in slices_of.points(i, a0, a1))
                        for col, v in zip(out, (start, end, *texts_of.points(w, b0, b1), n, 1 - miss / n), strict=True):
                            col.append(v)
            take = pa.array(rows, pa.int64())
            types = [pa.int64()] * 4 + [pa.int32(), pa.float64()]
            c = [pa.array(v, k) for v, k in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), c[0], c[1], batch.column(1).take(take), *c[2:]],
                                             names=["doc_id", "start", "end", "other_id", "other_start", "other_end", "n_words", "identity"])

    others = texts.select(F.col("at").alias("other"), F.col("doc_id").alias("other_id"), "packed")
    # a text that is repeated under one id is one text
    return (cut.join(others, "other").select("doc_id", "other_id", "xs", "ys", "slice", "shift", "packed")
            .mapInArrow(aligned, f"doc_id {kind}, start long, end long, other_id {kind}, other_start long, other_end long, n_words int, identity double")
            .distinct())
