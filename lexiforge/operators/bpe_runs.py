"""Exact BPE training over whole lines: many merges a round, made one by one on the runs of frequent pairs.

A merge in whole lines may cross words, so nearly every frequent pair has neighbours as frequent, and few merges
are certain from the counts alone (`bpe._Pairs.batch`).  Here a round looks at the text itself, but only where
the next merges can happen:

* the pairs are counted, and those that come first, down to a count ``least``, are *hot*;
* a *run* is a longest piece of a unit in which every pair is hot.  The distinct runs and how often each occurs
  hold every occurrence of every hot pair, and of all pairs that merges of hot pairs can make in them;
* the driver takes the merges from the runs as the sequential trainer would, down to ``least``;
* the tasks make the same merges in the runs of the written table.

Between two runs lies a pair that is not hot (*cold*).  What grows on both sides of it is a cold pair's text too,
and so less frequent than ``least``, unless one string is made in several ways.  For such strings the counts of
all cold pairs that may have become one are added up, and a round ends before such a sum could matter.  The first
merge of a round is always certain.

The driver holds at most HELD_SYMBOLS symbols of distinct runs; ``least`` is raised until they fit, and if the best
pair has too many equals, only the first of them are hot.
"""

from __future__ import annotations

import contextlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.text import UNK
from lexiforge.operators import bpe

HELD_SYMBOLS = 2_000_000  # of distinct runs, on the driver
HELD_PAIRS = 1_000_000  # on the driver, unless all of them are equally frequent
TASK_SYMBOLS = 4_000_000  # of runs that a task holds before it adds them up
FEWEST_HOT = 256  # pairs, however few merges are wanted
SHARE, LEAST_SHARE = 1 / 4, 1 / 64  # of the best pair's count: as low as the first round goes, and as any


# --- tasks ---------------------------------------------------------------------------------


def _runs(flat: np.ndarray, finder: bpe._Finder) -> tuple[np.ndarray, np.ndarray]:
    """The places of a row that are in runs, and the indices of these at which a run begins."""
    hot = np.zeros(len(flat) + 1, dtype=bool)
    hot[finder.every(flat)[0]] = True
    after = np.concatenate([[False], hot[:-1]])  # behind a hot pair's first symbol
    places = np.flatnonzero(hot | after)
    return places, np.flatnonzero(~after[places])


def _summed_runs(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("run", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["run", "n"])


def runs_task(hot: np.ndarray):
    """(run, n): the distinct runs of a task's rows; one may come again once many have been held."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, parts, held = bpe._Finder(hot), [], 0
        for batch in batches:
            for flat, freq in bpe._flat(batch):
                places, starts = _runs(flat, finder)
                if not len(places):
                    continue
                ends = 4 * np.append(starts, len(places)).astype(np.int32)
                run = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(flat[places].astype(np.int32))])
                parts.append(_summed_runs([pa.table({"run": run, "n": bpe._freq_at(flat, freq, places[starts])})]))
                held += parts[-1]["run"].nbytes // 4
                if held > TASK_SYMBOLS:
                    parts = [_summed_runs(parts)]
                    held = parts[0]["run"].nbytes // 4
                    if held > TASK_SYMBOLS // 2:
                        yield from parts[0].combine_chunks().to_batches()
                        parts, held = [], 0
        if parts:
            yield from _summed_runs(parts).combine_chunks().to_batches()

    return task


def made_in(flat: np.ndarray, finder: bpe._Finder, layers: list[tuple[bpe._Finder, np.ndarray]]) -> np.ndarray:
    """A row after the merges of the layers, which are made in its runs only."""
    places, starts = _runs(flat, finder)
    if not len(places):
        return flat
    first = np.zeros(len(places), dtype=np.int64)
    first[starts] = 1
    at = np.arange(len(places)) + np.cumsum(first) - 1  # each run is followed by -1
    runs, where = np.full(len(places) + len(starts), -1, dtype=np.int64), np.full(len(places) + len(starts), -1, dtype=np.int64)
    runs[at], where[at] = flat[places], places
    for layer, symbols in layers:
        at, which = layer.places(runs)
        if len(at):
            keep = np.ones(len(runs), dtype=bool)
            keep[at + 1] = False
            runs[at] = symbols[which]
            runs, where = runs[keep], where[keep]
    keep = np.ones(len(flat), dtype=bool)
    keep[places] = False
    keep[where[runs >= 0]] = True
    flat[where[runs >= 0]] = runs[runs >= 0]  # a task's own copy
    return flat[keep]


def fold_task(hot: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, made = bpe._Finder(hot), [(bpe._Finder(keys), symbols) for keys, symbols in layers]
        for batch in batches:
            for flat, freq in bpe._flat(batch):
                yield from bpe._packed(made_in(flat, finder, made), freq)

    return task


def ended(runs: pa.ChunkedArray) -> np.ndarray:
    """The symbols of the runs, with -1 after each run."""
    sizes = pc.binary_length(runs).to_numpy() // 4
    return bpe._ended(np.frombuffer(b"".join(x.as_buffer() for x in runs), dtype=np.int32), sizes)


@contextlib.contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries made inside are dropped when these end: nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _deleted(stored: DataFrame) -> None:
    place = stored.sparkSession._jvm.org.apache.hadoop.fs.Path(stored._written_to)
    place.getFileSystem(stored.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


class RunTable(bpe._UnitTable):
    """The written unit table, written anew after every round; the table before it is then deleted."""

    def counts(self, track: int) -> tuple[np.ndarray, np.ndarray]:
        with _swept(self.table.sparkSession):
            return super().counts(track)

    def runs(self, hot: np.ndarray, limit: int | None) -> tuple[np.ndarray, np.ndarray] | None:
        """All distinct runs as one array, each followed by -1, and how often each occurs; none if they have more symbols."""
        with _swept(self.table.sparkSession):
            found = bpe._stored(self.table.mapInArrow(runs_task(hot), "run binary, n bigint").groupBy("run").agg(F.sum("n").alias("n")))
        if limit is not None and (found.agg(F.sum(F.octet_length("run"))).first()[0] or 0) > 4 * limit:
            _deleted(found)
            return None
        rows = found.toArrow()
        _deleted(found)
        return ended(rows.column("run")), rows.column("n").to_numpy()

    def make(self, hot: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Make the merges of a round in the written table."""
        before = self.table
        self.table = bpe._stored(before.mapInArrow(fold_task(hot, layers), self.SCHEMA))
        _deleted(before)


# --- driver --------------------------------------------------------------------------------


class Runs:
    """Distinct runs with their counts, and merges made in them one after the other.

    Places are kept of pairs at least as frequent as ``least``; those of others are searched if they are needed.
    """

    def __init__(self, flat: np.ndarray, n: np.ndarray, least: int):
        self.least, self.sym = least, flat.astype(np.int32)
        self.next, self.prev = np.arange(1, len(flat) + 1, dtype=np.int32), np.arange(-1, len(flat) - 1, dtype=np.int32)
        self.n = np.repeat(n, np.diff(np.flatnonzero(flat < 0), prepend=-1))
        at = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))
        self.at: dict[int, list[np.ndarray]] = {k: [p] for k, p in self._by_pair(at)}  # places of a pair, and some where it was
        self.count: dict[int, int] = {k: int(self.n[p].sum()) for k, (p,) in self.at.items()}

    def _keys(self, at: np.ndarray) -> np.ndarray:
        return self.sym[at].astype(np.int64) << 32 | self.sym[self.next[at]]

    def _pairs(self, *at: np.ndarray) -> np.ndarray:
        """The places at which a pair begins, each once."""
        places = np.unique(np.concatenate(at))
        places = places[self.sym[places] >= 0]
        return places[self.sym[self.next[places]] >= 0]

    def _by_pair(self, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        keys = self._keys(at)
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order].astype(np.int32)
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        return zip(keys[starts].tolist(), np.split(at, starts[1:]) if len(at) else [], strict=True)

    def _places(self, left: int, right: int) -> np.ndarray:
        held = self.at.pop(left << 32 | right, None)
        if held is None:
            p = np.flatnonzero(self.sym == left)
        else:
            p = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            p = p[self.sym[p] == left]
        return p[self.sym[self.next[p]] == right]

    def pairs_of(self, symbol: int) -> list[int]:
        """The pairs that the symbol is in."""
        at = np.flatnonzero(self.sym == symbol)
        return np.unique(self._keys(self._pairs(self.prev[at], at))).tolist()

    def merge(self, left: int, right: int, symbol: int) -> list[int]:
        """Make a merge everywhere; returns the pairs that became more frequent."""
        p = self._places(left, right)
        if left == right and len(p) > 1:  # one symbol over and over: from the left
            first = np.concatenate([[True], p[1:] != self.next[p[:-1]]])
            at = np.arange(len(p))
            p = p[(at - at[first][np.cumsum(first) - 1]) % 2 == 0]
        q = self.next[p]
        old = self._pairs(self.prev[p], p, q)
        old_keys, old_n = self._keys(old), self.n[old]
        after = self.next[q]
        self.sym[p], self.sym[q], self.next[p], self.prev[after] = symbol, -2, after, p
        new = self._pairs(self.prev[p], p)
        pairs, by = bpe._summed(np.concatenate([old_keys, self._keys(new)]), np.concatenate([-old_n, self.n[new]]))
        more, begun = [], set()
        for k, d in zip(pairs.tolist(), by.tolist(), strict=True):
            had = self.count.get(k, 0)
            if had + d:
                self.count[k] = had + d
            else:
                self.count.pop(k, None)
            if d > 0:
                more.append(k)
                if not had and d >= self.least:
                    begun.add(k)
        for k, places in self._by_pair(new):
            if k in self.at:
                self.at[k].append(places)
            elif k in begun:
                self.at[k] = [places]
        return more


class _Between:
    """How frequent pairs between runs can be, at most.

    Of each symbol made in a round it knows which symbols of the round's beginning may be its first and its last:
    several only if its string, or that of a part of it, is made in several ways.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, floor: int):
        order = np.argsort(keys)
        self.keys, self.n, self.floor = keys[order], n[order], floor  # of the cold pairs; others are at most ``floor``
        order = np.argsort(self.keys & 0xFFFFFFFF, kind="stable")
        self.by_right, self.right = order, (self.keys & 0xFFFFFFFF)[order]
        self.ends: tuple[dict[int, frozenset], dict[int, frozenset]] = {}, {}  # symbol -> its firsts, its lasts
        self.several: tuple[set[frozenset], set[frozenset]] = set(), set()
        self.wide: tuple[set[int], set[int]] = set(), set()  # symbols with several firsts, several lasts
        self.most = 0

    def end(self, symbol: int, last: bool) -> frozenset:
        return self.ends[last].get(symbol) or frozenset([symbol])

    def made(self, left: int, right: int, symbol: int, again: bool) -> bool:
        """Take in a merge; returns whether the symbol's pairs may lie in runs and between them."""
        for last, part in ((False, left), (True, right)):
            ends = self.end(part, last)
            if again:
                ends |= self.end(symbol, last)
            self.ends[last][symbol] = ends
            if len(ends) > 1:
                self.wide[last].add(symbol)
                if ends not in self.several[last]:
                    self.several[last].add(ends)
                    self._allow(ends, last)
        return symbol in self.wide[False] or symbol in self.wide[True]

    def _allow(self, ends: frozenset, last: bool) -> None:
        beside, n = [], []
        for e in ends:
            if last:
                part = slice(*np.searchsorted(self.keys, [e << 32, (e + 1) << 32]))
                beside.append(self.keys[part] & 0xFFFFFFFF)
            else:
                part = self.by_right[slice(*np.searchsorted(self.right, [e, e + 1]))]
                beside.append(self.keys[part] >> 32)
            n.append(self.n[part])
        beside, total = bpe._summed(np.concatenate(beside), np.concatenate(n))
        self.most = max(self.most, int(total.max(initial=0)) + self.floor * len(ends))
        sums = dict(zip(beside.tolist(), total.tolist(), strict=True))
        for others in self.several[not last]:
            self.most = max(self.most, sum(sums.get(o, 0) for o in others) + self.floor * len(ends) * len(others))

    def extra(self, left: int, right: int, hot: np.ndarray) -> int:
        """How many occurrences of a pair may lie between runs."""
        total = 0
        for e in self.end(left, True):
            for s in self.end(right, False):
                pair = e << 32 | s
                at = int(np.searchsorted(self.keys, pair))
                if at < len(self.keys) and self.keys[at] == pair:
                    total += int(self.n[at])
                elif self.floor:
                    at = int(np.searchsorted(hot, pair))
                    total += 0 if at < len(hot) and hot[at] == pair else self.floor
        return total


class _Layers:
    """Merges in their order as few layers, of which each can be made at once.

    Two merges must stay in order if one makes what the other takes, or if they can overlap.
    """

    def __init__(self):
        self.layers: list[dict[int, int]] = []
        self.last: tuple[dict[int, int], ...] = {}, {}, {}  # symbol -> 1 + the last layer that takes it as left, as right, that makes it

    def add(self, left: int, right: int, symbol: int) -> None:
        as_left, as_right, made = self.last
        k = max(as_right.get(left, 0), as_left.get(right, 0), made.get(left, 0), made.get(right, 0), as_left.get(symbol, 0), as_right.get(symbol, 0))
        if k == len(self.layers):
            self.layers.append({})
        self.layers[k][left << 32 | right] = symbol
        for at, x in ((as_left, left), (as_right, right), (made, symbol)):
            at[x] = max(at.get(x, 0), k + 1)

    def arrays(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.array(sorted(x), dtype=np.int64), np.array([x[k] for k in sorted(x)], dtype=np.int64)) for x in self.layers]


class _Best:
    """The runs' pairs by their counts, the most frequent first.

    A pair that may also lie between runs is held by the most that it can be: it is uncertain.
    """

    def __init__(self, runs: Runs, between: _Between, hot: np.ndarray, least: int, names: list[str]):
        self.runs, self.between, self.hot, self.least, self.names = runs, between, hot, least, names
        self.extra: dict[int, int] = {}
        self.heap = [item for k in runs.count if (item := self._item(k))]
        heapq.heapify(self.heap)

    def _item(self, pair: int) -> tuple | None:
        n = self.runs.count.get(pair, 0) + self.extra.get(pair, 0)
        return (-n, self.names[pair >> 32], self.names[pair & 0xFFFFFFFF], pair) if n >= self.least else None

    def first(self) -> tuple | None:
        """(-count, left, right, pair) of the best pair; none if it is uncertain or below ``least``."""
        while self.heap:
            item = self.heap[0]
            now = self._item(item[3])
            if now == item:
                return None if self.extra.get(item[3]) or -item[0] <= self.between.most else item
            if now:
                heapq.heapreplace(self.heap, now)
            else:
                heapq.heappop(self.heap)
        return None

    def merge(self, pair: int, symbol: int, again: bool) -> None:
        left, right = pair >> 32, pair & 0xFFFFFFFF
        more = self.runs.merge(left, right, symbol)
        if self.between.made(left, right, symbol, again) and again:
            more = {*more, *self.runs.pairs_of(symbol)}
        firsts, lasts = self.between.wide
        for k in more:
            if k >> 32 in lasts or k & 0xFFFFFFFF in firsts:
                self.extra[k] = self.between.extra(k >> 32, k & 0xFFFFFFFF, self.hot)
            if item := self._item(k):
                heapq.heappush(self.heap, item)


def learned(table, base: list[str], vocab_size: int, min_frequency: int, track: int) -> tuple[list[tuple[str, str]], int]:
    """All merges in order, and the number of rounds.  ``base``: the strings of the symbols 0, 1, ..."""
    names = list(base)
    number = {s: i for i, s in enumerate(names)}
    known = {UNK, *base}
    merges: list[tuple[str, str]] = []
    rounds, share = 0, SHARE
    while len(known) < vocab_size:
        for held in (min(track, HELD_PAIRS), track):
            keys, n = table.counts(held)
            floor = int(n.min()) if len(n) >= held else 0  # pairs as frequent as the last one may be missing
            use = n > floor
            if use.any() or floor < min_frequency:
                break
        else:
            raise ValueError(f"{track} pairs and more are equally frequent: raise track")
        keys, n = keys[use], n[use]
        if not len(n) or (best := int(n.max())) < min_frequency:
            break
        rounds += 1
        some = min(max(vocab_size - len(known), FEWEST_HOT), len(n))
        lowest = max(min_frequency, int(np.partition(n, len(n) - some)[len(n) - some]))
        first = sorted(np.flatnonzero(n == best).tolist(), key=lambda i: (names[keys[i] >> 32], names[keys[i] & 0xFFFFFFFF]))
        while True:  # until the distinct runs are few enough; those of one pair always are
            least = min(best, max(lowest, int(best * share)))
            hot = n >= least
            if share > 1:  # equally frequent pairs: only some of them
                hot[first[max(1, int(len(first) / share)):]] = False
            got = table.runs(np.sort(keys[hot]), HELD_SYMBOLS if hot.sum() > 1 else None)
            if got is not None:
                break
            share = 2 * share if share >= 1 else 1 if least == best else (1 + share) / 2
        if len(got[0]) < HELD_SYMBOLS // 4:
            share = max(LEAST_SHARE, min(share, 1) / 2)
        rest = [i for i in first if not hot[i]]
        before = (names[keys[rest[0]] >> 32], names[keys[rest[0]] & 0xFFFFFFFF]) if rest else None
        touched = {int(keys[i]) >> 32 for i in rest}, {int(keys[i]) & 0xFFFFFFFF for i in rest}
        pairs = _Best(Runs(*got, least), _Between(keys[~hot], n[~hot], floor), np.sort(keys[hot]), least, names)
        layers = _Layers()
        while len(known) < vocab_size and (item := pairs.first()) and (before is None or item[1:3] < before):
            _, l, r, pair = item
            if again := l + r in number:
                symbol = number[l + r]
            else:
                symbol = number[l + r] = len(names)
                names.append(l + r)
            merges.append((l, r))
            known.add(l + r)
            pairs.merge(pair, symbol, again)
            layers.add(pair >> 32, pair & 0xFFFFFFFF, symbol)
            if pair & 0xFFFFFFFF in touched[0] or pair >> 32 in touched[1]:
                break  # an equally frequent pair that was left out may have grown
        if len(known) < vocab_size:
            table.make(np.sort(keys[hot]), layers.arrays())
    return merges, rounds
