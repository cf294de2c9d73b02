"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

A word is a vector of how often each of the 90 letters ``a-z`` and U+00C0-U+00FF occurs in it.  A replaced
letter moves the vector by one up and one down (L1 distance 2), an inserted one by one up (distance 1).  So
the words of one length are one k-d tree, and a word searches the tree of its own length and that of the
next length; a box that is further away is pruned.  What the boxes leave is held against the letter counts
and then letter by letter in order.

**Crossings.**  At a split (letter, count) a search goes to its own side; it goes to the other side only
if its count lies at the split, as that takes the one move up or down it has.  Two words of one length
are separated at one first split, where the one below crosses up, so a search's first crossing is
always up and each pair is found once.  A crossing in the same letter can never happen twice: the
second would need a distance of two in that letter.

**Scale.**  The top of each tree is grown in rounds over the table of words: tasks return counts of
(node, letter, value) for the nodes above the limit, one aggregation adds them, and only the best split of a
node goes to the driver, which holds the splits (one per ``leaf`` words or so).  Every word is then sent to
its leaf as a home and to the leaves that its crossings reach as a visitor.  A leaf's homes make a tree of
their own in one task (at most ``leaf`` words, fewer if they are long); its visitors are streamed past.
Words with equal vectors cannot be split, nor can they be near each other; if there are more than the
limit, they are dealt to blocks and their visitors go to all blocks.

Defined results: null text has no words, a null doc_id counts as empty text; repeated rows count again.
Ties for the form go to the smaller word in code-point order.  An empty table gives no rows.  Letters
outside the class, digits and punctuation end a run; letter case other than A-Z is kept.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import written

LETTERS = 90
MIN_LENGTH, MIN_COUNT, DAMAGE, RATIO = 5, 3, 97, 2
LEAF = 16_384  # words of a leaf of the shared trees
LEAF_BYTES = 1 << 25  # and letters of a leaf
SMALL = 48  # words of a leaf of a task's own tree
HELD = 200_000  # distinct words that a counting task holds before it passes them on
CHUNK = 1 << 22

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
_INDEX = np.full(256, 255, dtype=np.uint8)
_INDEX[97:123] = np.arange(26)
_INDEX[192:256] = np.arange(26, LETTERS)

# what a search may still do: cross up first, then down; only up; nothing
FRESH, UPPED, DONE, SHORTER = range(4)
_UP = np.array([UPPED, -1, -1, DONE])
_DOWN = np.array([-1, DONE, -1, -1])


def count_words(docs: DataFrame, damage: int = DAMAGE) -> DataFrame:
    """(word, n): lower-cased runs of letters, with the stated damage, before any lower limit."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                runs: Counter = Counter()
                for run, n in Counter(RUN.findall(text.as_py() or "")).items():
                    runs[run.lower() if run.isascii() else run.translate(LOWER)] += n
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in runs.items():
                    h = zlib.crc32(run.encode(), start)
                    if h % damage == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                    held[run] += n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    return (docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(task, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")))


# --- vectors and trees ------------------------------------------------------------------------


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All letters' numbers in one array, and the words' lengths."""
    return _INDEX[np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)], np.array([len(w) for w in words], dtype=np.int64)


def vectors_of(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(row * LETTERS + flat, minlength=len(sizes) * LETTERS).reshape(-1, LETTERS).astype(np.int32)


@dataclass
class Tree:
    """Splits of one length's words; node 0 is the root, a node without a letter is a leaf."""

    letter: list[int] = field(default_factory=lambda: [-1])
    value: list[int] = field(default_factory=lambda: [0])
    child: list[int] = field(default_factory=lambda: [0])  # left; right is the next
    blocks: list[int] = field(default_factory=lambda: [1])

    def split(self, node: int, letter: int, value: int) -> None:
        self.letter[node], self.value[node], self.child[node] = letter, value, len(self.letter)
        for _ in range(2):
            for column, x in ((self.letter, -1), (self.value, 0), (self.child, 0), (self.blocks, 1)):
                column.append(x)

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every vector."""
        letter, value, child = (np.array(c) for c in (self.letter, self.value, self.child))
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while True:
            inner = letter[node] >= 0
            if not inner.any():
                return node
            n, r = node[inner], rows[inner]
            node[inner] = child[n] + (x[r, letter[n]] > value[n])

    def search(self, x: np.ndarray, state: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows of ``x`` whose box search reaches it, what they may still do)."""
        todo = [(0, np.arange(len(x)), state)]
        while todo:
            node, rows, state = todo.pop()
            if not len(rows):
                continue
            if self.letter[node] < 0:
                yield node, rows, state
                continue
            v = x[rows, self.letter[node]] - self.value[node]
            left, right = self.child[node], self.child[node] + 1
            for to, own, edge, after in ((left, v <= 0, v == 1, _DOWN[state]), (right, v > 0, v == 0, _UP[state])):
                cross = edge & (after >= 0)
                take = own | cross
                todo.append((to, rows[take], np.where(cross, after, state)[take]))


def _best_split(x: np.ndarray) -> tuple[int, int] | None:
    """The (letter, value) that halves the vectors best; None if they are all equal."""
    best, n = None, len(x)
    for value in np.unique(x)[:-1].tolist():
        below = (x <= value).sum(axis=0)
        skew = np.where((below > 0) & (below < n), np.abs(2 * below - n), n + 1)
        at = int(skew.argmin())
        if skew[at] <= n and (best is None or skew[at] < best[0]):
            best = (skew[at], at, value)
        if best and not (below < n // 2).any():
            break
    return best and best[1:]


def _signature(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits whose number of differences is at most the vectors' L1 distance: one to three of each
    letter a-z, and whether letters of a class occur for the rest."""
    bits = np.zeros((len(x), 128), dtype=bool)
    for k in range(3):
        bits[:, 26 * k:26 * k + 26] = x[:, :26] > k
    for c in range(26, LETTERS):
        bits[:, 78 + (c - 26) % 50] |= x[:, c] > 0
    packed = np.packbits(bits, axis=1).view(np.uint64)
    return packed[:, 0], packed[:, 1]


def _halves(codes: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first ``cut`` letters and of the others, over the rows of a letter matrix."""
    def hashed(part: np.ndarray) -> np.ndarray:
        h = np.full(len(part), 1469598103934665603, dtype=np.uint64)
        for j in range(part.shape[1]):
            h = (h ^ part[:, j]) * np.uint64(1099511628211)
        return h

    return hashed(codes[:, :cut]), hashed(codes[:, cut:])


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of letters of equal or next length: is it exactly one replaced or inserted letter?"""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    n = a.shape[1]
    head, tail = a != b[:, :-1], a != b[:, 1:]
    first = np.where(head.any(axis=1), head.argmax(axis=1), n)
    last = np.where(tail.any(axis=1), n - tail[:, ::-1].argmax(axis=1), 0)
    return last <= first


class Homes:
    """A leaf's words (all of one length) as a tree in one task."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = np.array(words, dtype=object), np.array(counts, dtype=np.int64)
        flat, sizes = letters_of(words)
        self.length = int(sizes[0])
        self.codes, self.x = flat.reshape(-1, self.length), vectors_of(flat, sizes)
        self.tree, self.members = Tree(), {0: np.arange(len(words))}
        todo = [0]
        while todo:
            node = todo.pop()
            at = self.members[node]
            found = _best_split(self.x[at]) if len(at) > SMALL else None
            if found is None:
                continue
            self.tree.split(node, *found)
            right = self.x[at, found[0]] > found[1]
            left = self.tree.child[node]
            self.members[left], self.members[left + 1] = at[~right], at[right]
            del self.members[node]
            todo += [left, left + 1]
        self.signature = _signature(self.x)
        self.half = {self.length: _halves(self.codes, self.length // 2), self.length - 1: _halves(self.codes, (self.length - 1) // 2)}
        self.shorter_tail = _halves(self.codes, (self.length - 1) // 2 + 1)[1]

    def pairs(self, words: list[str], state: np.ndarray, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of ``words``, homes) that are one edit apart; words of one length."""
        flat, sizes = letters_of(words)
        length = int(sizes[0])
        codes, x = flat.reshape(-1, length), vectors_of(flat, sizes)
        signature, (head, tail) = _signature(x), _halves(codes, length // 2)
        my_head = self.half[length][0]
        my_tail = self.half[length][1] if length == self.length else self.shorter_tail
        reach = 2 if length == self.length else 1
        for leaf, rows, now in self.tree.search(x, state):
            homes = self.members[leaf]
            if len(homes) > SMALL:  # equal vectors: words of this length that never crossed are anagrams
                rows, now = rows[now != FRESH], now[now != FRESH]
            for lo in range(0, len(rows), max(1, CHUNK // len(homes))):
                part = rows[lo:lo + max(1, CHUNK // len(homes))]
                far = sum(np.bitwise_count(s[part][:, None] ^ m[homes][None, :]) for s, m in zip(signature, self.signature, strict=True))
                near = far <= reach
                if own:  # words of one leaf meet twice
                    near &= (now[lo:lo + len(part)] != FRESH)[:, None] | (part[:, None] < homes[None, :])
                i, j = np.nonzero(near)
                i, j = part[i], homes[j]
                like = (head[i] == my_head[j]) | (tail[i] == my_tail[j])  # one edit leaves one half as it is
                i, j = i[like], j[like]
                step = max(1, CHUNK // (length + 1))
                for at in range(0, len(i), step):
                    a, b = i[at:at + step], j[at:at + step]
                    ok = one_edit(codes[a], self.codes[b])
                    yield a[ok], b[ok]


# --- distributed search -----------------------------------------------------------------------


def limit_of(length: int, leaf: int = LEAF) -> int:
    return max(1, min(leaf, LEAF_BYTES // length))


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.array([len(w) for w in words])
    for length in np.unique(sizes):
        yield int(length), np.flatnonzero(sizes == length)


def grow(words: DataFrame, leaf: int = LEAF) -> dict[int, Tree]:
    """The shared trees of a (word) table: every leaf has at most ``limit_of`` words or one vector."""
    sizes = words.groupBy(F.length("word").alias("length")).count().collect()  # one row a length
    trees = {r["length"]: Tree() for r in sizes}
    big = {(r["length"], 0): r["count"] for r in sizes if r["count"] > limit_of(r["length"], leaf)}
    while big:
        open_nodes = {length: np.array(sorted(n for m, n in big if m == length)) for length, _ in big}
        sent = words.sparkSession.sparkContext.broadcast((trees, open_nodes))

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            trees, open_nodes = sent.value
            for batch in batches:
                texts = batch.column(0).to_pylist()
                for length, rows in _by_length(texts):
                    if length not in open_nodes:
                        continue
                    x = vectors_of(*letters_of([texts[r] for r in rows]))
                    node = trees[length].homes(x)
                    use = np.isin(node, open_nodes[length])
                    if not use.any():
                        continue
                    x, node = x[use], node[use]
                    key = (node[:, None] * LETTERS + np.arange(LETTERS)) * (int(x.max()) + 1) + x
                    u, n = np.unique(key, return_counts=True)
                    u, value = np.divmod(u, int(x.max()) + 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(u), length), pa.int32()), pa.array(u // LETTERS, pa.int64()), pa.array(u % LETTERS, pa.int32()),
                         pa.array(value, pa.int32()), pa.array(n, pa.int64())], names=["length", "node", "letter", "value", "n"])

        counts = (words.select("word").mapInArrow(task, "length int, node bigint, letter int, value int, n bigint")
                  .groupBy("length", "node", "letter", "value").agg(F.sum("n").alias("n")))
        along = Window.partitionBy("length", "node", "letter").orderBy("value")
        whole = Window.partitionBy("length", "node", "letter")
        cuts = (counts.select("length", "node", "letter", "value", F.sum("n").over(along).alias("below"), F.sum("n").over(whole).alias("total"))
                .groupBy("length", "node").agg(F.min(F.when(F.col("below") < F.col("total"), F.struct(
                    F.abs(2 * F.col("below") - F.col("total")).alias("skew"), "letter", "value", "below", "total"))).alias("best"),
                    F.max("total").alias("total")).collect())
        big = {}
        for r in cuts:
            length, node, best, limit = r["length"], r["node"], r["best"], limit_of(r["length"], leaf)
            if best is None:
                trees[length].blocks[node] = -(-r["total"] // limit)
                continue
            trees[length].split(node, best["letter"], best["value"])
            left = trees[length].child[node]
            for child, n in ((left, best["below"]), (left + 1, best["total"] - best["below"])):
                if n > limit:
                    big[length, child] = n
        sent.unpersist()
    return trees


def _dealt(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """(length, leaf, block, visitor state or -1 for a home, word, n)."""
    sent = words.sparkSession.sparkContext.broadcast(trees)

    def rows_of(texts: list[str], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for length, rows in _by_length(texts):
            x = vectors_of(*letters_of([texts[r] for r in rows]))
            for to in (length, length + 1):
                tree = trees.get(to)
                if tree is None:
                    continue
                start = FRESH if to == length else SHORTER
                for leaf, at, state in tree.search(x, np.full(len(x), start)):
                    home = state == FRESH
                    blocks = tree.blocks[leaf]
                    own = np.array([zlib.crc32(texts[r].encode()) % blocks for r in rows[at[home]]], dtype=np.int64)
                    visit = np.tile(at[~home], blocks)
                    r = rows[np.concatenate([at[home], visit])]
                    block = np.concatenate([own, np.repeat(np.arange(blocks), (~home).sum())])
                    kind = np.concatenate([np.full(len(own), -1), np.tile(state[~home], blocks)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(r), to), pa.int32()), pa.array(np.full(len(r), leaf), pa.int64()), pa.array(block, pa.int32()),
                         pa.array(kind, pa.int32()), pa.array([texts[i] for i in r], pa.string()), pa.array(counts[r], pa.int64())],
                        names=["length", "leaf", "block", "state", "word", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from rows_of(batch.column(0).to_pylist(), batch.column(1).to_numpy())

    return words.select("word", "n").mapInArrow(task, "length int, leaf bigint, block int, state int, word string, n bigint")


def near_pairs(words: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(a, na, b, nb): every two words of a (word, n) table that are one edit apart, once."""
    dealt = _dealt(words, grow(words, leaf)).repartition("length", "leaf", "block").sortWithinPartitions("length", "leaf", "block", "state")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(homes: Homes, texts: list[str], counts: np.ndarray, states: np.ndarray, own: bool = False) -> Iterator[pa.RecordBatch]:
            for _, rows in _by_length(texts):
                mine = [texts[r] for r in rows]
                for i, j in homes.pairs(mine, states[rows], own):
                    i = rows[i]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([texts[r] for r in i], pa.string()), pa.array(counts[i], pa.int64()),
                         pa.array(homes.words[j], pa.string()), pa.array(homes.counts[j], pa.int64())], names=["a", "na", "b", "nb"])

        def opened(words_: list[str], counts: list[int]) -> tuple[Homes | None, Iterator]:
            if not words_:
                return None, iter(())
            homes = Homes(words_, counts)
            return homes, found(homes, words_, homes.counts, np.full(len(words_), FRESH), own=True)

        key, homes, waiting = None, None, ([], [])
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
            state = batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if key is None or tuple(keys[lo]) != key:
                    if waiting[0]:
                        yield from opened(*waiting)[1]
                    key, homes, waiting = tuple(keys[lo]), None, ([], [])
                texts, n = batch.column(4).slice(lo, hi - lo).to_pylist(), batch.column(5).slice(lo, hi - lo).to_numpy()
                home = int((state[lo:hi] < 0).sum())  # homes come first
                waiting[0].extend(texts[:home])
                waiting[1].extend(n[:home].tolist())
                if home < hi - lo:
                    if homes is None:
                        homes, own = opened(*waiting)
                        waiting = ([], [])
                        yield from own
                    if homes is not None:
                        yield from found(homes, texts[home:], n[home:], state[lo + home:hi])
        if waiting[0]:
            yield from opened(*waiting)[1]

    return dealt.mapInArrow(task, "a string, na bigint, b string, nb bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a (word, form) table without cycles: the last form, by pointer doubling."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                      "spelling-roots")
        if not now.where("moved").take(1):
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, damage: int = DAMAGE,
             leaf: int = LEAF) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text)."""
    words = written(count_words(docs, damage).where((F.length("word") >= min_length) & (F.col("n") >= min_count)), "spelling-words")
    both = near_pairs(words, leaf).select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    form = -F.col("best.m") >= ratio * F.col("n")
    joined = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(form, F.col("best.other")).alias("form"), F.when(form, -F.col("best.m")).alias("form_n")), "spelling-forms")
    last = roots(joined.where("form is not null"))
    return joined.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
