"""Byte-pair-encoding tokenizer: training units, pair statistics, exact training, encode, ids.

Training is exact and distributed.  The unit table (distinct unit -> frequency) is a written table of
integer symbol sequences; symbol numbers are local to one training run, and one string has one number.
A round is one job over it: tasks apply a whole batch of merges at once, vectorised, and return the
changed pair counts, summed before they reach the driver.

The batch holds every merge that a sequential trainer is certain to make just so, though not yet in
which order: the best pair, and every pair (c, d) that nothing can touch before its turn, because

* it is more frequent than all pairs (x, c) and (d, y), so its occurrences stay as they are: whatever x and
  y grow into, (xx, c) and (d, yy) are no more frequent than the pairs they began as;
* the same holds for the sums over strings that begin (end) with one another, as one string can be
  reached in several ways, and for all pairs that would spell c or d anew;
* nothing else in the batch spells the same string, and if a known symbol does, no pair of that symbol is
  or becomes as frequent as (c, d).

Pairs of equal frequency are ordered by their strings, and that order is used where it is certain.  Which
merge came when follows afterwards: `_Order` takes committed merges by frequency and strings, as the
sequential trainer would, once their symbols exist, and no further than the best pair not yet merged.

The driver holds the pairs with their counts, at most ``track`` of them before the rarest are dropped; the
rest is then known only to be no more frequent than ``floor``, which the rules above allow for.  They
are counted again when the best pair is no longer above it.  The alphabet is bounded by the code points.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.functions.text import END_OF_WORD, UNK, chars, col_
from lexiforge.session import scratch_path

FOLD_EVERY = 8  # rounds between two writes of the unit table
TRACK = 2_000_000  # pairs that the driver holds
SYMBOLS_PER_TASK = 250_000
CHUNK = 1 << 17  # symbols in a row of the unit table, unless one unit is longer
UNITS_AT_ONCE = 1000  # numbered together
TABLE = 1 << 20  # cells of a table of pairs; larger sets are searched
HELD = 2_000_000  # changed pairs that a task holds before it adds them up
FEW_TASKS = 32
ASKED = 4096  # pairs whose neighbours a round may ask for
PATIENCE = 5  # rounds before a pair that was uncertain is looked at again
WORDS_HELD = 200_000  # different words that a task holds while it counts
MEMO_WORDS = 50_000  # encoded words that a worker remembers
OUT_TOKENS = 200_000  # tokens that leave a worker at once
NORMALIZED = 2_000_000  # characters that a worker normalises at once


def preprocess(text, lowercase: bool = True, normalize: str | None = None) -> Column:
    """Unicode normalisation (NFC/NFD/NFKC/NFKD) then lowercase."""
    t = col_(text)
    if normalize:
        t = normalize_udf(normalize)(t)
    if lowercase:
        t = F.lower(t)
    return t


def normalize_udf(form: str):
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown normalisation {form}")

    @F.arrow_udf(T.StringType())
    def _norm(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import unicodedata

        for texts in batches:
            out, held = [], 0
            for x in texts:  # one text at a time becomes a Python string
                t = x.as_py()
                out.append(None if t is None else unicodedata.normalize(form, t))
                held += len(t or "")
                if held >= NORMALIZED:
                    yield pa.array(out, pa.string())
                    out, held = [], 0
            if out:
                yield pa.array(out, pa.string())

    return _norm


def training_units(df: DataFrame, text_col: str, lowercase: bool = True, normalize: str | None = None,
                   unit: str = "word") -> DataFrame:
    """(unit, freq): whitespace words (default) or whole non-empty lines, counted."""
    pre = preprocess(F.col(text_col), lowercase, normalize)
    if unit == "word":
        counted = df.select(pre.alias("text")).mapInArrow(_word_counts, "unit string, freq bigint")
        return counted.groupBy("unit").agg(F.sum("freq").alias("freq"))
    elif unit == "line":
        u = df.select(pre.alias("unit")).where(F.col("unit").isNotNull() & (F.col("unit") != ""))
    else:
        raise ValueError(f"unknown unit {unit}")
    return u.groupBy("unit").agg(F.count(F.lit(1)).alias("freq"))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, freq) of a task's texts; a word may come again once WORDS_HELD others have been met."""
    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["unit", "freq"])

    counts: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0):  # one text at a time becomes a Python string
            counts.update((text.as_py() or "").split())
            if len(counts) >= WORDS_HELD:
                yield rows()
                counts = Counter()
    if counts:
        yield rows()


def symbol_arrays(units: DataFrame) -> DataFrame:
    """(symbols, freq): the characters of each unit and the end-of-word marker."""
    return units.select(F.concat(chars(F.col("unit")), F.array(F.lit(END_OF_WORD))).alias("symbols"), "freq")


def alphabet(units: DataFrame) -> DataFrame:
    """Distinct symbols of the units plus the end-of-word marker (rows are reduced to their
    distinct characters before the shuffle)."""
    syms = units.select(F.explode(F.array_distinct(chars(F.col("unit")))).alias("symbol")).distinct()
    return syms.unionByName(units.sparkSession.createDataFrame([(END_OF_WORD,)], "symbol string")).distinct()


def pair_stats(seqs: DataFrame) -> DataFrame:
    """(l, r, freq): overlapping adjacent pairs weighted by unit frequency."""
    s = F.col("symbols")
    zipped = F.arrays_zip(F.slice(s, F.lit(1), F.size(s) - 1).alias("l"), F.slice(s, F.lit(2), F.size(s) - 1).alias("r"))
    p = seqs.select(F.explode(zipped).alias("p"), "freq")
    return p.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("freq").alias("freq"))


def best_pair(stats: DataFrame, min_frequency: int = 1) -> DataFrame:
    """Most frequent pair with freq >= min_frequency; ties -> smallest (l, r)."""
    return stats.where(F.col("freq") >= min_frequency).orderBy(F.desc("freq"), "l", "r").limit(1)


@dataclass
class BpeModel:
    merges: list[tuple[str, str]]
    tokens: list[str]
    lowercase: bool = True
    normalize: str | None = None
    name: str = "bpe"
    unit: str = "word"
    stats: dict = field(default_factory=dict)

    @property
    def vocab(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    @property
    def unk_id(self) -> int:
        return self.vocab.get(UNK, 0)

    def merges_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, l, r, l + r) for i, (l, r) in enumerate(self.merges)],
                                     "rank int, left string, right string, merged string")

    def vocab_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, i) for i, t in enumerate(self.tokens)], "token string, id int")


# --- training ------------------------------------------------------------------------------


def _flat(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All sequences of a row in one array, each followed by -1, and the frequency of each of them.

    A row of the written table holds many units, as bytes (`_packed`); a batch may also hold a unit a row.
    """
    seq, freq = batch.column(0), batch.column(1)
    if pa.types.is_binary(seq.type):
        for s, n in zip(seq, freq, strict=True):
            yield np.frombuffer(s.as_buffer(), dtype=np.int32).astype(np.int64), np.frombuffer(n.as_buffer(), dtype=np.int64)
    elif batch.num_rows:
        sizes = np.diff(seq.offsets.to_numpy())
        yield _ended(seq.flatten().to_numpy().astype(np.int64), sizes), freq.to_numpy()


def _ended(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The symbols of sequences of these sizes, with -1 after each sequence."""
    flat = np.full(len(symbols) + len(sizes), -1, dtype=np.int64)
    inside = np.ones(len(flat), dtype=bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    flat[inside] = symbols
    return flat


def _packed(flat: np.ndarray, freq: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of about CHUNK symbols each; a longer sequence has a row of its own."""
    ends = np.flatnonzero(flat < 0)
    at = unit = 0
    while unit < len(ends):
        stop = max(unit + 1, int(np.searchsorted(ends, at + CHUNK)))
        end = int(ends[stop - 1]) + 1
        yield pa.RecordBatch.from_arrays([pa.array([flat[at:end].astype(np.int32).tobytes()], pa.binary()),
                                          pa.array([freq[unit:stop].astype(np.int64).tobytes()], pa.binary())], names=["seq", "freq"])
        at, unit = end, stop


class _Finder:
    """Where the pairs ``keys`` (sorted) occur; made once a task, asked once a row.

    A symbol is a row of a table if some pair begins with it, and a column if some pair ends with it.
    """

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        left, right = keys >> 32, keys & 0xFFFFFFFF
        size = int(max(left.max(initial=0), right.max(initial=0))) + 2  # -1 finds the last, which stays unset
        lefts, rights = np.unique(left), np.unique(right)
        self.mark = np.zeros((2, size), dtype=bool)
        self.mark[0, lefts] = self.mark[1, rights] = True
        self.table = None
        if len(lefts) * len(rights) <= TABLE:
            self.row, self.col = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
            self.row[lefts], self.col[rights] = np.arange(len(lefts)) * len(rights), np.arange(len(rights))
            self.table = np.full(len(lefts) * len(rights), -1, dtype=np.int32)
            self.table[self.row[left] + self.col[right]] = np.arange(len(keys))

    def every(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of the pairs, those that overlap as well, and which pair each is."""
        more = int(flat.max(initial=0)) + 2 - self.mark.shape[1]
        if more > 0:
            self.mark = np.pad(self.mark, ((0, 0), (0, more)))
        at = np.flatnonzero(self.mark[0][flat[:-1]])
        at = at[self.mark[1][flat[at + 1]]]
        if self.table is not None:
            which = self.table[self.row[flat[at]] + self.col[flat[at + 1]]]
            found = which >= 0
        else:
            pair = flat[at] << 32 | flat[at + 1]
            which = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            found = self.keys[which] == pair
        return at[found], which[found]

    def places(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the non-overlapping occurrences, and which pair each is.

        Only a symbol's pair with itself can overlap (`_Pairs.batch`); it is taken from the left.
        """
        at, which = self.every(flat)
        if len(at) > 1:
            first = np.concatenate([[True], at[1:] - at[:-1] != 1])
            if not first.all():
                taken = (at - at[first][np.cumsum(first) - 1]) % 2 == 0
                at, which = at[taken], which[taken]
        return at, which


def _merged(flat: np.ndarray, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    if not len(at):
        return flat
    keep = np.ones(len(flat), dtype=bool)
    keep[at + 1] = False
    flat[at] = symbols  # a task's own copy
    return flat[keep]


def _parted(flat: np.ndarray, freq: np.ndarray, finder: _Finder, others: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(flat, freq) of the units without any of the pairs, if the ``others`` are asked for, and of those with one."""
    at = finder.every(flat)[0]
    if not len(at):
        return *((flat, freq) if others else (flat[:0], freq[:0])), flat[:0], freq[:0]
    ends = np.flatnonzero(flat < 0)
    hit = np.unique(np.searchsorted(ends, at))
    sizes = ends[hit] - np.where(hit > 0, ends[hit - 1], -1)
    places = np.arange(int(sizes.sum())) + np.repeat(ends[hit] + 1 - np.cumsum(sizes), sizes)
    some = flat[places], freq[hit]
    if not others:
        return flat[:0], freq[:0], *some
    outside, rest = np.ones(len(flat), dtype=bool), np.ones(len(ends), dtype=bool)
    outside[places] = rest[hit] = False
    return flat[outside], freq[rest], *some


class _Replay:
    """Merges that are not yet folded into the table, ready to be made in a task's rows.

    The first merge that changes a unit finds its pair in the unit as it is stored, so only units with such
    pairs are taken through the steps.  The same holds for the pairs ``also``, to be merged next.
    """

    def __init__(self, steps: list[tuple[np.ndarray, np.ndarray]], also: np.ndarray | None = None):
        self.steps = [(_Finder(keys), symbols) for keys, symbols in steps]
        every = [keys for keys, _ in steps] + ([] if also is None else [also])
        self.any = _Finder(np.unique(np.concatenate(every))) if every else None

    def parts(self, batch: pa.RecordBatch, others: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Row by row (flat, freq) of the units that none of the pairs is in (``others``: if they are asked for),
        and of the others after the merges."""
        for flat, freq in _flat(batch):
            rest, rest_freq, some, some_freq = (flat, freq, flat[:0], freq[:0]) if self.any is None else _parted(flat, freq, self.any, others)
            for finder, symbols in self.steps:
                at, which = finder.places(some)
                some = _merged(some, at, symbols[which])
            yield rest, rest_freq, some, some_freq

    def rows(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A batch's sequences, row by row, after the merges; the units they changed come last in the row."""
        for rest, rest_freq, some, some_freq in self.parts(batch):
            yield np.concatenate([rest, some]), np.concatenate([rest_freq, some_freq])


def _freq_at(flat: np.ndarray, freq: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The frequencies of the units that hold the places."""
    return freq[np.searchsorted(np.flatnonzero(flat < 0), places)]


def _pairs_at(flat: np.ndarray, freq: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs at the places, each place once, and the frequencies of the units that hold them."""
    asked = np.zeros(len(flat) + 1, dtype=bool)  # places before the first pair and behind the last fall out
    asked[places] = True
    places = np.flatnonzero(asked[:max(0, len(flat) - 1)])
    left, right = flat[places], flat[places + 1]
    ok = (left >= 0) & (right >= 0)
    return left[ok] << 32 | right[ok], _freq_at(flat, freq, places[ok])


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values[order], first)


class _Sums:
    """Sums by (pair, beside) over the rows of a task: one batch a task leaves it, however many rows it reads."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, pair: np.ndarray, n: np.ndarray, beside: np.ndarray | None = None) -> None:
        if len(pair):
            self.parts.append((pair, n, np.zeros(len(pair), dtype=np.int64) if beside is None else beside))
            self.held += len(pair)
            if self.held > HELD:
                self.parts = [self.total()]
                self.held = min(len(self.parts[0][0]), HELD // 2)

    def total(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return (np.empty(0, dtype=np.int64),) * 3
        pair, n, beside = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        if not beside.any():
            u, total = _summed(pair, n)
            return u, total, np.zeros(len(u), dtype=np.int64)
        order = np.lexsort((beside, pair))
        pair, n, beside = pair[order], n[order], beside[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(beside) != 0)]))
        return pair[first], np.add.reduceat(n, first), beside[first]


def _touches(keys: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    return np.isin(keys >> 32, symbols) | np.isin(keys & 0xFFFFFFFF, symbols)


def _counts_task(steps: list[tuple[np.ndarray, np.ndarray]]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, replay = _Sums(), _Replay(steps)
        for batch in batches:
            for flat, freq in replay.rows(batch):
                sums.add(*_summed(*_pairs_at(flat, freq, np.arange(len(flat)))))
        keys, n, _ = sums.total()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

    return task


def _changes_task(steps: list, keys: np.ndarray, symbols: np.ndarray, fresh: int, again: np.ndarray, tracked: np.ndarray | None,
                  asked: list[np.ndarray]):
    """Pair-count changes by one batch; of the symbols ``again``, known before, all pairs with their
    whole counts (kind 1).  ``tracked``: the only old pairs whose changes are asked for.  ``asked``: pairs
    whose next (kind 2) or previous (kind 3) symbols are counted after the batch."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [_Sums() for _ in range(4)]  # by kind
        replay, now_merged = _Replay(steps, keys), _Finder(keys)
        around = [(kind, _Finder(keys_), step) for kind, keys_, step in ((2, asked[0], 2), (3, asked[1], -1)) if len(keys_)]
        for batch in batches:
            for rest, rest_freq, flat, freq in replay.parts(batch, bool(len(again) or around)):
                at, which = now_merged.places(flat)
                old, old_n = _pairs_at(flat, freq, np.concatenate([at - 1, at, at + 1]))
                flat = _merged(flat, at, symbols[which])
                now = at - np.arange(len(at))
                new, new_n = _pairs_at(flat, freq, np.concatenate([now - 1, now]))
                sums[0].add(*_summed(np.concatenate([old, new]), np.concatenate([-old_n, new_n])))
                if len(again) or around:
                    flat, freq = np.concatenate([rest, flat]), np.concatenate([rest_freq, freq])
                if len(again):
                    sums[1].add(*_summed(*_pairs_at(flat, freq, np.concatenate([(x := np.flatnonzero(np.isin(flat, again))) - 1, x]))))
                for kind, finder, step in around:
                    at, _ = finder.every(flat)
                    at = at[at + step >= 0]  # what follows a unit's last symbol is its end mark
                    beside = flat[at + step]
                    at, beside = at[beside >= 0], beside[beside >= 0]
                    sums[kind].add(flat[at] << 32 | flat[at + 1], _freq_at(flat, freq, at), beside)
        pair, d, beside = sums[0].total()
        use = d != 0
        if tracked is not None:
            use &= (pair >> 32 >= fresh) | (pair & 0xFFFFFFFF >= fresh) | np.isin(pair, tracked)
        if len(again):
            use &= ~_touches(pair, again)
        out = [(pair[use], d[use], beside[use]), *(s.total() for s in sums[1:])]
        pair, d, beside = (np.concatenate(c) for c in zip(*out, strict=True))
        if len(pair):
            kind = np.repeat(np.arange(4, dtype=np.int32), [len(x[0]) for x in out])
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(d), pa.array(kind), pa.array(beside)], names=["pair", "d", "kind", "beside"])

    return task


def _fold_task(steps: list[tuple[np.ndarray, np.ndarray]]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _Replay(steps)
        for batch in batches:
            for flat, freq in replay.rows(batch):
                yield from _packed(flat, freq)

    return task


def _unit_rows(batches: Iterator[pa.RecordBatch], sequences) -> Iterator[pa.RecordBatch]:
    """Rows of the unit table from (unit, freq); ``sequences``: list of units -> (symbols, sizes)."""
    parts, held = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, UNITS_AT_ONCE):
            some = batch.slice(lo, UNITS_AT_ONCE)
            flat = _ended(*sequences(some.column(0).to_pylist()))
            parts.append((flat, some.column(1).to_numpy()))
            held += len(flat)
            if held >= CHUNK:
                yield from _packed(*(np.concatenate(c) for c in zip(*parts, strict=True)))
                parts, held = [], 0
    if parts:
        yield from _packed(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def _code_points(units: list[str]) -> np.ndarray:
    return np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32)


def _numbered_task(points: np.ndarray, numbers: np.ndarray, end: int):
    """Units as sequences of symbol numbers."""
    numbers = np.append(numbers, end)

    def sequences(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(u) + 1 for u in units])
        symbols = numbers[np.searchsorted(points, _code_points([u + "\0" for u in units]))]
        symbols[np.cumsum(sizes) - 1] = end
        return symbols, sizes

    return lambda batches: _unit_rows(batches, sequences)


def _stored(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "bpe-units")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _tasks(units: DataFrame) -> int:
    symbols = units.agg(F.sum(F.length("unit") + 1)).first()[0] or 0
    return max(1, min(2 * units.sparkSession.sparkContext.defaultParallelism, -(-symbols // SYMBOLS_PER_TASK)))


def _agree(x: str, rest: str, before: bool) -> bool:
    """May what stands beside a symbol be a part of a string that spells ``rest`` there, or more?"""
    return x.endswith(rest) or rest.endswith(x) if before else x.startswith(rest) or rest.startswith(x)


class _Pairs:
    """Counts of all pairs that are more frequent than ``floor``, and the choice of a round's batch."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, floor: int, names: list[str], number: dict[str, int]):
        self.floor, self.names, self.number = floor, names, number
        self.round, self.again = 0, {}  # pair -> the round in which it may be certain
        self.asking: dict[tuple[int, bool], None] = {}
        # (pair, before) -> strings before or after the pair, and how often.  The text around a pair never
        # changes, so that these stay upper bounds until one of its symbols is spelled anew
        self.beside: dict[tuple[int, bool], dict[str, int]] = {}
        self.replace(keys, counts)

    def replace(self, keys: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.n = keys[order], counts[order]
        self.by_right = np.argsort(self.keys & 0xFFFFFFFF, kind="stable")
        self.right = (self.keys & 0xFFFFFFFF)[self.by_right]

    def asked(self) -> list[np.ndarray]:
        """Pairs whose next and previous symbols would settle uncertain candidates."""
        return [np.array([p for p, before in self.asking if before == b], dtype=np.int64) for b in (False, True)]

    def update(self, pair: np.ndarray, d: np.ndarray, kind: np.ndarray, beside: np.ndarray, again: np.ndarray, track: int) -> None:
        """Take in a round's changes."""
        if len(again):
            spelled = set(again.tolist())
            self.beside = {k: v for k, v in self.beside.items() if k[0] >> 32 not in spelled and k[0] & 0xFFFFFFFF not in spelled}
        for p, before in self.asking:
            self.beside[p, before] = {}
        for p, n, k, x in zip(pair[kind > 1].tolist(), d[kind > 1].tolist(), kind[kind > 1].tolist(), beside[kind > 1].tolist(), strict=True):
            around = self.beside[p, k == 3]
            around[self.names[x]] = around.get(self.names[x], 0) + n
        self.asking = {}
        whole, pair, d = kind[kind < 2] == 1, pair[kind < 2], d[kind < 2]
        changed, by = _summed(pair[~whole], d[~whole])
        every, total = _summed(pair[whole], d[whole])
        keys, n = self.keys, self.n.copy()
        if len(again):
            keep = ~_touches(keys, again)
            keys, n = keys[keep], n[keep]
        at = np.minimum(np.searchsorted(keys, changed), max(0, len(keys) - 1))
        known = keys[at] == changed if len(keys) else np.zeros(len(at), dtype=bool)
        n[at[known]] += by[known]
        keys = np.concatenate([keys, changed[~known], every])
        n = np.concatenate([n, by[~known], total])
        if (n > self.floor).sum() > track:  # no more are dropped than must be: what is unknown makes merges uncertain
            held = max(1, track - track // 8)
            self.floor = int(np.partition(n, len(n) - held)[len(n) - held])
        keep = n > self.floor
        self.replace(keys[keep], n[keep])

    def key(self, i: int) -> tuple:
        return (-int(self.n[i]), self.names[self.keys[i] >> 32], self.names[self.keys[i] & 0xFFFFFFFF])

    def best(self) -> int | None:
        if not len(self.n):
            return None
        return min(np.flatnonzero(self.n == self.n.max()).tolist(), key=self.key)

    def count(self, left: int, right: int) -> int:
        pair = left << 32 | right
        at = int(np.searchsorted(self.keys, pair))
        return int(self.n[at]) if at < len(self.keys) and self.keys[at] == pair else 0

    def _beside(self, symbol: int, before: bool) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that come after (``before``: before) a symbol, and how often."""
        if before:
            part = self.by_right[slice(*np.searchsorted(self.right, [symbol, symbol + 1]))]
            return self.keys[part] >> 32, self.n[part]
        part = slice(*np.searchsorted(self.keys, [symbol << 32, (symbol + 1) << 32]))
        return self.keys[part] & 0xFFFFFFFF, self.n[part]

    def _onward(self, s: str, rest: str, before: bool) -> int:
        """How frequent a merge of ``s`` with what stands beside it may become that goes on to spell ``rest``
        (from its near end), a part of it, or more."""
        got = self.seen.get((s, rest, before))
        if got is not None:
            return got
        if before not in self.sorted:
            spelled = [x[::-1] for x in self.names] if before else self.names
            order = sorted(range(len(spelled)), key=spelled.__getitem__)
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            self.sorted[before] = ([spelled[i] for i in order], rank)
        spelled, rank = self.sorted[before]
        near = rest[::-1] if before else rest
        lo, hi = bisect.bisect_left(spelled, near), bisect.bisect_left(spelled, near + "\U0010ffff")
        symbol = self.number[s]
        others, n = self._beside(symbol, before)
        more = (rank[others] >= lo) & (rank[others] < hi)
        around = dict(zip((spelled[r] for r in rank[others[more]].tolist()), n[more].tolist(), strict=True))
        total = max((c + sum(around.get(x[:i], 0) for i in range(len(near), len(x))) for x, c in around.items()), default=0)
        for i in range(1, len(rest)):
            other = self.number.get(rest[-i:] if before else rest[:i])
            if other is not None:
                total += self.count(other, symbol) if before else self.count(symbol, other)
        self.seen[s, rest, before] = total
        return total

    def _rivalled(self, symbol: int, before: bool, count: int, slack: int) -> bool:
        """May a string beside the symbol, reached in several ways, be as frequent as ``count`` before its turn?

        A shorter string reaches a longer one only by a merge that is as frequent itself.
        """
        if (symbol, before) not in self.chains:
            others, n = self._beside(symbol, before)
            if len(others) < 2 or int(n.sum()) + slack < count:
                return bool(slack and len(n)) and int(n.max()) + slack >= count
            around = {self.names[o]: c for o, c in zip(others.tolist(), n.tolist(), strict=True)}
            chains = []
            for s, c in around.items():
                parts = [t for i in range(1, len(s)) if (t := s[i:] if before else s[:i]) in around]
                if parts:
                    chains.append((c + sum(around[t] for t in parts), s, parts))
            self.chains[symbol, before] = (around, sorted(chains, reverse=True), max(around.values(), default=0))
        around, chains, most = self.chains[symbol, before]
        if slack and most + slack >= count:
            return True
        for total, s, parts in chains:
            if total + slack < count:
                return False
            others, unsure = 0, []
            for t in parts:
                rest = s[:-len(t)] if before else s[len(t):]
                if self._onward(t, rest, before) + slack >= count:
                    pair = self.number[t] << 32 | symbol if before else symbol << 32 | self.number[t]
                    known = self.beside.get((pair, before))
                    others += around[t] if known is None else sum(k for x, k in known.items() if _agree(x, rest, before))
                    unsure += [(pair, before)] if known is None else []
            if (others or slack) and around[s] + others + slack >= count:
                if len(self.asking) < ASKED:
                    self.asking.update(dict.fromkeys(unsure))
                return True
        return False

    def _spelled(self, s: str) -> int:
        """How often the string might be spelled anew, at most: over its first pairs, what can go on to its end."""
        @functools.cache
        def way(a: int, b: int, c: int) -> int:
            left, right = self.number.get(s[a:b]), self.number.get(s[b:c])
            n = 0 if left is None or right is None else self.count(left, right)
            return n if not n or c == len(s) else min(n, sum(way(b, c, d) for d in range(c + 1, len(s) + 1)))

        return sum(way(0, b, c) for b in range(1, len(s)) for c in range(b + 1, len(s) + 1))

    def batch(self, wanted: int, min_frequency: int, made: list[int]) -> list[int]:
        """Indices of the best pair and of those that are certain, as far as they can be among the ``wanted``
        next merges together with those ``made`` (their counts) whose turn has not come."""
        top = self.best()
        if top is None or self.n[top] < min_frequency:
            return []
        every = np.concatenate([self.n, np.array(made, dtype=np.int64)])
        at = len(every) - min(wanted, len(every))
        least = max(min_frequency, int(np.partition(every, at)[at]))
        some = np.flatnonzero(self.n >= min(least, self.n[top]))
        n, left, right = self.n[some], self.keys[some] >> 32, self.keys[some] & 0xFFFFFFFF
        most_after, most_before = np.zeros(len(self.names), dtype=np.int64), np.zeros(len(self.names), dtype=np.int64)
        np.maximum.at(most_after, left, n)
        np.maximum.at(most_before, right, n)
        used, place = np.unique(np.concatenate([left, right]), return_inverse=True)
        order = np.argsort(np.argsort(np.array([self.names[u] for u in used], dtype=object)))[place]
        lo, ro = order[:len(left)], order[len(left):]  # ranks of the strings
        tied = n == most_before[right]
        blocked = np.zeros(len(self.names), dtype=bool)  # a tied pair (x, c) comes first, or x may grow
        blocked[right[tied & ((lo <= ro) | (most_before[left] >= n))]] = True
        ok = ((n > most_after[right]) | ((n == most_after[right]) & (lo < ro))) & ((n > most_before[left]) | ((n == most_before[left]) & ~blocked[left]))
        strings = {self.names[self.keys[top] >> 32] + self.names[self.keys[top] & 0xFFFFFFFF]}
        out = [top]
        self.round += 1
        self.seen, self.chains, self.sorted = {}, {}, {}
        slack = self.floor * (1 + max(len(self.names[u]) for u in used))  # of pairs that are not held: no more strings than letters
        for i in some[ok][np.argsort(-n[ok], kind="stable")].tolist():
            c, d, count = int(self.keys[i] >> 32), int(self.keys[i] & 0xFFFFFFFF), int(self.n[i])
            s = self.names[c] + self.names[d]
            if i == top or s in strings or self.round < self.again.get(int(self.keys[i]), 0):
                continue
            asking = len(self.asking)
            if (any(self._spelled(self.names[x]) + slack >= count for x in (c, d)) or self._rivalled(d, False, count, slack)
                    or self._rivalled(c, True, count, slack) or (s in self.number and self._crowded(c, d, self.number[s], count, slack))):
                self.again[int(self.keys[i])] = self.round + (1 if len(self.asking) > asking else PATIENCE)
                continue
            strings.add(s)
            out.append(i)
        return out

    def _crowded(self, c: int, d: int, symbol: int, count: int, slack: int) -> bool:
        """Might a pair of a symbol that is known already become as frequent as the merge that spells it anew?"""
        for before, end in ((False, d), (True, c)):
            around: dict[str, int] = {}
            for x in (symbol, end):
                others, n = self._beside(x, before)
                for o, k in zip(others.tolist(), n.tolist(), strict=True):
                    around[self.names[o]] = around.get(self.names[o], 0) + k
            for s, n in around.items():
                if n + slack + sum(around.get(s[i:] if before else s[:i], 0) for i in range(1, len(s))) >= count:
                    return True
        return False


class _Order:
    """Committed merges in the order in which a sequential trainer makes them."""

    def __init__(self):
        self.ready: list[tuple] = []
        self.waiting: dict[int, list[tuple]] = {}
        self.maker: dict[int, int] = {}  # symbol -> the last committed merge that made it
        self.taken: set[int] = set()
        self.made = 0

    def commit(self, key: tuple, left: int, right: int, symbol: int) -> None:
        needs = {m for m in (self.maker.get(left), self.maker.get(right)) if m is not None and m not in self.taken}
        self._hold((key, self.made, symbol, needs))
        self.made += 1

    def sealed(self, symbols: list[tuple[int, int]]) -> None:
        """The round's merges (number, symbol) may be built upon from now on."""
        self.maker.update({symbol: number for number, symbol in symbols})

    def pending(self) -> list[int]:
        """Counts of the merges whose turn has not come."""
        return [-item[0][0] for items in (self.ready, *self.waiting.values()) for item in items]

    def _hold(self, item: tuple) -> None:
        key, number, symbol, needs = item
        if needs:
            self.waiting.setdefault(next(iter(needs)), []).append(item)
        else:
            heapq.heappush(self.ready, (key, number, symbol))

    def take(self, best: tuple | None) -> Iterator[tuple[tuple, int]]:
        """(key, symbol) of all merges that come before the best pair not yet merged."""
        while self.ready and (best is None or self.ready[0][0] < best):
            key, number, symbol = heapq.heappop(self.ready)
            self.taken.add(number)
            for k, n, s, needs in self.waiting.pop(number, []):
                self._hold((k, n, s, needs - self.taken))
            yield key, symbol


class _UnitTable:
    """The written unit table, the merges not yet folded into it, and the jobs over both.

    A row holds the sequences of many units as bytes, so a round moves and scans plain arrays, row by row.
    """

    SCHEMA = "seq binary, freq binary"

    def __init__(self, units: DataFrame, points: np.ndarray, numbers: np.ndarray, end: int):
        self.parts = _tasks(units)
        self.table = _stored(units.repartition(self.parts).mapInArrow(_numbered_task(points, numbers, end), self.SCHEMA))
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []

    def counts(self, track: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``track`` most frequent pairs."""
        counted = self.table.mapInArrow(_counts_task(self.steps), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        rows = counted.orderBy(F.desc("n")).limit(track).toArrow()
        return rows.column("pair").to_numpy(), rows.column("n").to_numpy()

    def apply(self, keys: np.ndarray, symbols: np.ndarray, fresh: int, again: np.ndarray, pairs: _Pairs) -> list[np.ndarray]:
        """Make a batch of merges; returns the changes as pair, d, kind, beside (`_changes_task`)."""
        task = _changes_task(self.steps, keys, symbols, fresh, again, pairs.keys if pairs.floor else None, pairs.asked())
        rows = self.table.mapInArrow(task, "pair bigint, d bigint, kind int, beside bigint")
        if self.parts > FEW_TASKS or pairs.floor:  # a few tasks' rows are as soon added up on the driver
            rows = rows.groupBy("pair", "kind", "beside").agg(F.sum("d").alias("d")).select("pair", "d", "kind", "beside")
        if pairs.floor:  # new pairs below it need not travel
            old = (F.shiftright("pair", 32) < fresh) & (F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)) < fresh)
            rows = rows.where((old & (F.col("kind") == 0)) | (F.col("kind") > 1) | (F.col("d") > pairs.floor))
        rows = rows.toArrow()
        self.steps.append((keys, symbols))
        if len(self.steps) >= FOLD_EVERY:
            self.table, self.steps = _stored(self.table.mapInArrow(_fold_task(self.steps), self.SCHEMA)), []
        return [c.to_numpy() for c in rows.columns]


def _learned(table: _UnitTable, base: list[str], vocab_size: int, min_frequency: int, track: int) -> tuple[list[tuple[str, str]], int]:
    """All merges in order, and the number of rounds.  ``base``: the strings of the symbols 0, 1, ..."""
    names = list(base)
    number = {s: i for i, s in enumerate(names)}
    known = {UNK, *base}
    merges: list[tuple[str, str]] = []

    def fetch() -> _Pairs:
        keys, n = table.counts(track)
        floor = int(n.min()) if len(n) >= track else 0  # pairs as frequent as the last one may be missing
        return _Pairs(keys[n > floor], n[n > floor], floor, names, number)

    pairs, order, rounds = fetch(), _Order(), 0
    while True:
        top = pairs.best()
        if top is None and pairs.floor >= min_frequency:
            pairs = fetch()
            top = pairs.best()
            if top is None:
                raise ValueError(f"{track} pairs and more are equally frequent: raise track")
        ended = top is None or pairs.n[top] < min_frequency
        for key, symbol in order.take(None if ended else pairs.key(top)):
            if len(known) >= vocab_size:
                break
            merges.append((key[1], key[2]))
            known.add(names[symbol])
        if ended or len(known) >= vocab_size:
            return merges, rounds
        rounds += 1
        fresh, again, made, got = len(names), [], [], {}
        for i in pairs.batch(vocab_size - len(known), min_frequency, order.pending()):
            key, pair = pairs.key(i), int(pairs.keys[i])
            s = key[1] + key[2]
            if s in number:
                again.append(number[s])
            else:
                number[s] = len(names)
                names.append(s)
            got[pair] = number[s]
            made.append((order.made, number[s]))
            order.commit(key, pair >> 32, pair & 0xFFFFFFFF, number[s])
        order.sealed(made)
        keys = np.array(sorted(got), dtype=np.int64)
        symbols = np.array([got[int(k)] for k in keys], dtype=np.int64)
        again = np.array(again, dtype=np.int64)
        pairs.update(*table.apply(keys, symbols, fresh, again, pairs), again, track)


def train(units: DataFrame, vocab_size: int, min_frequency: int = 1, track: int = TRACK,
          lowercase: bool = True, normalize: str | None = None, name: str = "bpe", unit: str = "word") -> BpeModel:
    """Exact BPE training over a (unit, freq) table.

    Same result as the sequential trainer: at every step the most frequent pair (ties:
    smallest (left, right)) with frequency >= ``min_frequency`` is merged, until the
    vocabulary holds ``vocab_size`` tokens or no pair qualifies.  Ids: ``<unk>`` = 0, then the
    sorted alphabet, then merged tokens in merge order, truncated to ``vocab_size``.

    ``unit``: what the units are.  Of words a round makes the merges that their counts alone make certain; in lines
    these are few, and a round looks at the text around frequent pairs (`bpe_runs`).
    """
    if vocab_size <= 0 or min_frequency <= 0:
        raise ValueError("vocab_size and min_frequency must be positive")
    units = _stored(units.select("unit", F.col("freq").cast("bigint").alias("freq")))
    base = sorted({END_OF_WORD, *(r[0] for r in alphabet(units).collect())})
    merges, rounds = [], 0
    if len({UNK, *base}) < vocab_size:
        letters = sorted((ord(s), i) for i, s in enumerate(base) if len(s) == 1)
        points, numbers = (np.array([x[j] for x in letters], dtype=np.int64) for j in (0, 1))
        if unit == "line":
            from lexiforge.operators import bpe_runs

            merges, rounds = bpe_runs.learned(bpe_runs.RunTable(units, points, numbers, base.index(END_OF_WORD)), base, vocab_size, min_frequency, track)
        else:
            merges, rounds = _learned(_UnitTable(units, points, numbers, base.index(END_OF_WORD)), base, vocab_size, min_frequency, track)
    tokens = list(dict.fromkeys([UNK, *base, *(l + r for l, r in merges)]))[:vocab_size]
    return BpeModel(merges, tokens, lowercase, normalize, name, unit, {"rounds": rounds})


def table_check(merges: DataFrame) -> DataFrame:
    """Is a merge table safe for rank-order encoding (one ``replace`` pass per merge)?

    Holds when every merged string has exactly one producer, every operand longer than
    one symbol is produced at a lower rank, and no merged string equals a marker.
    Returns one row of counts and ``ok``.
    """
    m = merges.select("rank", "left", "right", F.concat("left", "right").alias("merged"))
    producers = m.groupBy("merged").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first_rank"))
    multi = producers.where(F.col("n") > 1).agg(F.count(F.lit(1)).alias("v")).withColumn("k", F.lit("multi_producer"))
    operands = m.select("rank", F.explode(F.array("left", "right")).alias("operand")).where(
        (F.length("operand") > 1) & (F.col("operand") != END_OF_WORD))
    late = (operands.join(producers.select(F.col("merged").alias("operand"), "first_rank"), "operand", "left")
            .where(F.col("first_rank").isNull() | (F.col("first_rank") >= F.col("rank")))
            .agg(F.count(F.lit(1)).alias("v")).withColumn("k", F.lit("unordered_operand")))
    clash = (m.where(F.col("merged").isin(END_OF_WORD, UNK)).agg(F.count(F.lit(1)).alias("v"))
             .withColumn("k", F.lit("marker_clash")))
    n = m.agg(F.count(F.lit(1)).alias("v")).withColumn("k", F.lit("n_merges"))
    metrics = n.unionByName(multi).unionByName(late).unionByName(clash)
    out = metrics.agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k)
                        for k in ("n_merges", "multi_producer", "unordered_operand", "marker_clash")])
    return out.withColumn("ok", ((F.col("multi_producer") + F.col("unordered_operand") + F.col("marker_clash")) == 0)
                          .cast("int"))


# --- encoding ------------------------------------------------------------------------------


class _Encoder:
    """Merge table, ids and a memo of encoded words; broadcast, so every worker holds one."""

    def __init__(self, model: BpeModel):
        self.ranks = {p: i for i, p in reversed(list(enumerate(model.merges)))}
        self.ids, self.unk = model.vocab, model.unk_id
        self.memo: dict[str, tuple[list[str], list[int]]] = {}
        self.spelled: dict[str, str] = {}

    def word(self, word: str) -> list[str]:
        """Merge the lowest-ranked adjacent pair everywhere, from the left, until none is ranked: a
        heap of ranked places over a doubly linked list of symbols."""
        syms: list[str | None] = [*word, END_OF_WORD]
        n = len(syms)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(self.ranks[p], i) for i, p in enumerate(itertools.pairwise(syms)) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, changed = heap[0][0], []
            while heap and heap[0][0] == rank:
                i = heapq.heappop(heap)[1]
                j = after[i]
                if syms[i] is None or j >= n or self.ranks.get((syms[i], syms[j])) != rank:
                    continue
                syms[i], syms[j] = syms[i] + syms[j], None
                after[i] = after[j]
                if after[i] < n:
                    before[after[i]] = i
                changed.append(i)
            for i in changed:
                if syms[i] is None:
                    continue
                for a in {before[i], i}:
                    if a >= 0 and after[a] < n and (syms[a], syms[after[a]]) in self.ranks:
                        heapq.heappush(heap, (self.ranks[syms[a], syms[after[a]]], a))
        out = [s for s in syms if s is not None]
        return out[:-1] if out[-1] == END_OF_WORD else out

    def text(self, text: str | None) -> tuple[list[str], list[int]] | None:
        if text is None:
            return None
        toks: list[str] = []
        ids: list[int] = []
        for w in text.split():
            got = self.memo.get(w)
            if got is None:
                t = self.word(w)
                t = [self.spelled.setdefault(x, x) for x in t]  # one string a token, not one a word
                got = self.memo[w] = (t, [self.ids.get(x, self.unk) for x in t])
            toks += got[0]
            ids += got[1]
        return toks, ids


def encoded(text, model: BpeModel) -> Column:
    """struct<tokens, ids> of a text column: null in, null out; unknown tokens get the id of ``<unk>``.
    Text, merge table and vocabulary may hold any characters and have any size."""
    return token_udf(_Encoder(model))(preprocess(col_(text), model.lowercase, model.normalize))


def token_udf(encoder):
    """Column function text -> struct<tokens, ids> by ``encoder.text``; the encoder is broadcast.  However many texts a
    batch holds, about OUT_TOKENS tokens, or one text's, are in a worker's hands at a time."""
    sent = SparkSession.getActiveSession().sparkContext.broadcast(encoder)

    @F.arrow_udf("tokens array<string>, ids array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from _token_slices(texts, sent.value.text)

    return run


def _token_slices(texts: pa.Array, encode) -> Iterator[pa.Array]:
    """The texts' (tokens, ids) as arrays of one or more texts."""
    rows, held = [], 0
    for x in texts:
        rows.append(encode(x.as_py()))
        held += len(rows[-1][0]) if rows[-1] else 0
        if held >= OUT_TOKENS:
            yield _token_rows(rows)
            rows, held = [], 0
    if rows:
        yield _token_rows(rows)


def _token_rows(rows: list) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([r and r[0] for r in rows], pa.list_(pa.string())),
                                       pa.array([r and r[1] for r in rows], pa.list_(pa.int32()))], names=["tokens", "ids"])


def apply_tokenizer(df: DataFrame, fields: Sequence[str], model: BpeModel, add_ids: bool = True) -> DataFrame:
    """Add ``{field}_tokens`` (and ``{field}_ids``) for each text field; other columns pass
    through, null fields stay null.  Stateless, so it runs on streams unchanged."""
    for f in fields:
        if f not in df.columns:
            continue
        df = df.withColumn("_enc", encoded(F.col(f), model)).withColumn(f"{f}_tokens", F.col("_enc.tokens"))
        if add_ids:
            df = df.withColumn(f"{f}_ids", F.col("_enc.ids"))
        df = df.drop("_enc")
    return df


def tokenized_counts(df: DataFrame, fields: Sequence[str], by: str) -> DataFrame:
    """(by, tokenized_records): the number of tokenized (row, field) pairs of every group."""
    present = [F.col(f"{f}_tokens").isNotNull().cast("long") for f in fields if f"{f}_tokens" in df.columns]
    return df.groupBy(by).agg(F.sum(sum(present[1:], present[0]) if present else F.lit(0).cast("long")).alias("tokenized_records"))


def oov_rates(df: DataFrame, by: str, field: str, model: BpeModel) -> DataFrame:
    """(by, n_tokens, n_unk, oov_rate) of an encoded field: the share of tokens without an id of their own."""
    ids = F.col(f"{field}_ids")
    per = df.select(by, F.size(ids).alias("n"), F.size(F.filter(ids, lambda x: x == F.lit(model.unk_id))).alias("u"))
    out = per.groupBy(by).agg(F.sum("n").alias("n_tokens"), F.sum("u").alias("n_unk"))
    return out.withColumn("oov_rate", F.round(F.when(F.col("n_tokens") > 0, F.col("n_unk") / F.col("n_tokens")).otherwise(F.lit(0.0)), 6))


def tokenizer_hash(model: BpeModel, spark: SparkSession) -> DataFrame:
    """One row ``tokenizer_hash``: SHA-256 over the canonical merge lines (by rank) followed
    by the canonical vocabulary lines (by token).  The model is vocabulary-sized, so each
    part is one bounded group."""
    from lexiforge.functions.hashing import ordered_join

    m = model.merges_frame(spark).select("rank", F.to_json(F.struct("left", "rank", "right")).alias("line"))
    v = model.vocab_frame(spark).select("token", F.to_json(F.struct("id", "token")).alias("line"))
    parts = (m.select(F.lit(0).alias("part"), F.format_string("%012d", "rank").alias("o"), "line")
             .unionByName(v.select(F.lit(1).alias("part"), F.col("token").alias("o"), "line")))
    return parts.agg(ordered_join(F.struct("part", "o"), "line").alias("j")).select(
        F.sha2("j", 256).alias("tokenizer_hash"))


def training_corpus(df: DataFrame, text_col: str, order_col: str, limit: int | None = None) -> DataFrame:
    """Training texts: rows whose text field is a non-null string, and with ``limit`` only
    the first ``limit`` accepted rows in ``order_col`` order (rows without text do not count
    against the limit).  The limit is a top-k over an explicit key, so it is deterministic."""
    rows = df.where(F.col(text_col).isNotNull()).select(order_col, text_col)
    return rows.orderBy(order_col).limit(limit) if limit is not None else rows
