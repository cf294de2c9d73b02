"""WordPiece tokenizer: training by likelihood gain, longest-match encoding.

A word is spelled by its first character and its others with the prefix ``##``.  Each step merges the pair
with the greatest ``f(ab) / (f(a) * f(b))`` among those at least ``min_frequency`` frequent (ties: the smallest
(left, right)).  Unlike in byte-pair encoding a frequent pair is not a good one, and a score rises when
its symbols become rarer elsewhere, so the driver needs every pair that may qualify: those with the
minimum frequency, and the frequency of each symbol.  Both are bounded by the vocabulary, not by the text.

A round is one job over the written unit table (`bpe._stored`).  Tasks make the merges that the driver
expects next, one after the other, and return the changes of each step; the driver replays the steps as
long as each is the best one at its turn.  The first always is.  The rest of the round is not kept.

Encoding takes the longest token of the vocabulary that continues the word, from a trie; a word that cannot
be spelled is ``[UNK]`` as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.text import chars, col_
from lexiforge.operators import bpe

PREFIX, UNK = "##", "[UNK]"
FOLD_EVERY = 32  # merges between two writes of the unit table
SPECULATE = 32  # merges that a round tries


@dataclass
class WordPieceModel:
    merges: list[tuple[str, str]]
    tokens: list[str]
    lowercase: bool = True

    @property
    def vocab(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    def merges_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, l, r, joined(l, r)) for i, (l, r) in enumerate(self.merges)],
                                     "rank int, left string, right string, merged string")

    def vocab_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, i) for i, t in enumerate(self.tokens)], "token string, id int")


def joined(left: str, right: str) -> str:
    return left + right[len(PREFIX):]


def alphabet(units: DataFrame) -> DataFrame:
    """Distinct symbols of a (unit, freq) table: first characters, and the others with the prefix."""
    c = chars(F.col("unit"))
    symbols = F.concat(F.slice(c, 1, 1), F.transform(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda x: F.concat(F.lit(PREFIX), x)))
    return units.where("unit <> ''").select(F.explode(F.array_distinct(symbols)).alias("symbol")).distinct()


def _numbered_task(number: dict[str, int]):
    points = np.array(sorted({ord(s[-1]) for s in number}), dtype=np.int64)  # of a symbol's only character
    first, rest = (np.array([number.get(prefix + chr(c), -1) for c in points], dtype=np.int64) for prefix in ("", PREFIX))

    def sequences(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(u) for u in units])
        at = np.searchsorted(points, bpe._code_points(units))
        symbols, starts = rest[at], np.cumsum(sizes) - sizes
        symbols[starts] = first[at[starts]]
        return symbols, sizes

    return lambda batches: bpe._unit_rows(batches, sequences)


def _counts_task():
    """Frequencies of pairs, and of symbols as pairs with themselves (kind 1)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = bpe._Sums(), bpe._Sums()
        for batch in batches:
            for flat, freq in bpe._flat(batch):
                sums[0].add(*bpe._summed(*bpe._pairs_at(flat, freq, np.arange(len(flat)))))
                at = np.flatnonzero(flat >= 0)
                sums[1].add(*bpe._summed(flat[at], bpe._freq_at(flat, freq, at)))
        (pair, n, _), (symbol, m, _) = (s.total() for s in sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([pair, symbol])), pa.array(np.concatenate([n, m])),
             pa.array(np.repeat(np.array([0, 1], dtype=np.int32), [len(pair), len(symbol)]))], names=["pair", "n", "kind"])

    return task


def _tries_task(steps: list[tuple[np.ndarray, np.ndarray]], tries: list[tuple[int, int]], tracked: np.ndarray, fresh: int, again: bool):
    """Changes (step, pair, d, kind) of each tried merge (pair, symbol): kind 0 pairs, 1 the number of merges,
    2 whole counts of the pairs of a symbol that was known before (``again``: the only try makes such a one)."""
    tried = np.array([pair for pair, _ in tries])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[bpe._Sums() for _ in range(3)] for _ in tries]  # by step and kind
        replay, finders = bpe._Replay(steps, np.unique(tried)), [bpe._Finder(np.array([pair])) for pair, _ in tries]
        for batch in batches:
            for rest, rest_freq, flat, freq in replay.parts(batch):
                if again:  # else no try has a pair of symbols that another one makes
                    flat, freq = np.concatenate([rest, flat]), np.concatenate([rest_freq, freq])
                for (pair, symbol), finder, by_kind in zip(tries, finders, sums, strict=True):
                    at, _ = finder.places(flat)
                    if not len(at) and not again:
                        continue
                    old, old_n = bpe._pairs_at(flat, freq, np.concatenate([at - 1, at, at + 1]))
                    made = int(bpe._freq_at(flat, freq, at).sum())
                    flat = bpe._merged(flat, at, np.full(len(at), symbol))
                    now = at - np.arange(len(at))
                    new, new_n = bpe._pairs_at(flat, freq, np.concatenate([now - 1, now]))
                    by_kind[0].add(*bpe._summed(np.concatenate([old, new]), np.concatenate([-old_n, new_n])))
                    by_kind[1].add(np.array([pair]), np.array([made]))
                    if again:
                        x = np.flatnonzero(flat == symbol)
                        by_kind[2].add(*bpe._summed(*bpe._pairs_at(flat, freq, np.concatenate([x - 1, x]))))
        for k, ((_, symbol), by_kind) in enumerate(zip(tries, sums, strict=True)):
            for kind, s in enumerate(by_kind):
                keys, d, _ = s.total()
                if kind == 0:
                    use = (d != 0) & (np.isin(keys, tracked) | (keys >> 32 >= fresh) | (keys & 0xFFFFFFFF >= fresh))
                    if again:
                        use &= ~bpe._touches(keys, np.array([symbol]))
                    keys, d = keys[use], d[use]
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, dtype=np.int32)), pa.array(keys), pa.array(d),
                                                      pa.array(np.full(len(keys), kind, dtype=np.int32))], names=["step", "pair", "d", "kind"])

    return task


class _Scores:
    """All pairs of the minimum frequency, and the frequencies of the symbols."""

    def __init__(self, rows: pa.Table, names: list[str], min_frequency: int):
        kind, pair, n = (rows.column(c).to_numpy() for c in ("kind", "pair", "n"))
        self.names, self.min_frequency = names, min_frequency
        self.pairs = dict(zip(pair[kind == 0].tolist(), n[kind == 0].tolist(), strict=True))
        self.symbols = dict(zip(pair[kind == 1].tolist(), n[kind == 1].tolist(), strict=True))

    def leaders(self, n: int) -> list[int]:
        """The pairs of the best scores, best first."""
        if not self.pairs:
            return []
        keys = np.fromiter(self.pairs, dtype=np.int64, count=len(self.pairs))
        count = np.fromiter(self.pairs.values(), dtype=np.float64, count=len(self.pairs))
        f = np.zeros(len(self.names))
        f[list(self.symbols)] = list(self.symbols.values())
        score = count / (f[keys >> 32] * f[keys & 0xFFFFFFFF])
        least = np.partition(score, len(score) - min(n, len(score)))[len(score) - min(n, len(score))]
        some = np.flatnonzero(score >= least)
        order = sorted(some.tolist(), key=lambda i: (-score[i], self.names[keys[i] >> 32], self.names[keys[i] & 0xFFFFFFFF]))
        return keys[order[:n]].tolist()

    def merge(self, pair: int, symbol: int, made: int, changes: dict[int, int], whole: dict[int, int] | None) -> None:
        left, right = pair >> 32, pair & 0xFFFFFFFF
        for s, d in ((left, -made), (right, -made), (symbol, made)):
            self.symbols[s] = self.symbols.get(s, 0) + d
        for p, d in changes.items():
            self.pairs[p] = self.pairs.get(p, 0) + d
        if whole is not None:
            for p in [p for p in self.pairs if symbol in (p >> 32, p & 0xFFFFFFFF)]:
                del self.pairs[p]
            self.pairs.update(whole)
        for p in [*changes, *(whole or ())]:
            if self.pairs.get(p, 0) < self.min_frequency:
                self.pairs.pop(p, None)


def train(units: DataFrame, vocab_size: int, min_frequency: int = 2, speculate: int = SPECULATE, lowercase: bool = True) -> WordPieceModel:
    """Model of a (unit, freq) table of words: ``[UNK]`` = 0, the sorted alphabet, then merged tokens in order, until
    the vocabulary holds ``vocab_size`` tokens or no pair is frequent enough.  Empty units have no symbols."""
    if vocab_size <= 0 or min_frequency <= 0:
        raise ValueError("vocab_size and min_frequency must be positive")
    units = bpe._stored(units.where("unit <> ''").select("unit", F.col("freq").cast("bigint").alias("freq")))
    base = sorted(r[0] for r in alphabet(units).collect())
    names, number = list(base), {s: i for i, s in enumerate(base)}
    known, merges, schema = {UNK, *base}, [], bpe._UnitTable.SCHEMA
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    if len(known) < vocab_size:
        table = bpe._stored(units.repartition(bpe._tasks(units)).mapInArrow(_numbered_task(number), schema))
        counted = table.mapInArrow(_counts_task(), "pair bigint, n bigint, kind int").groupBy("pair", "kind").agg(F.sum("n").alias("n"))
        scores = _Scores(counted.where((F.col("kind") == 1) | (F.col("n") >= min_frequency)).toArrow(), names, min_frequency)
    while len(known) < vocab_size:
        fresh, tries, again = len(names), [], False
        for pair in scores.leaders(min(speculate, vocab_size - len(known))):
            s = joined(names[pair >> 32], names[pair & 0xFFFFFFFF])
            if s in number:  # made in a second way: a round of its own, with whole counts
                if not tries:
                    tries, again = [(pair, number[s])], True
                break
            number[s] = len(names)
            names.append(s)
            tries.append((pair, number[s]))
        if not tries:
            break
        tracked = np.fromiter(scores.pairs, dtype=np.int64, count=len(scores.pairs))
        old = (F.shiftright("pair", 32) < fresh) & (F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)) < fresh)
        rows = (table.mapInArrow(_tries_task(steps, tries, tracked, fresh, again), "step int, pair bigint, d bigint, kind int")
                .groupBy("step", "pair", "kind").agg(F.sum("d").alias("d")))
        # a pair's count is positive at one step only if it is new there: below the minimum it never qualifies
        rows = rows.where(old | (F.col("kind") == 1) | (F.col("d") < 0) | (F.col("d") >= min_frequency)).toArrow()
        got: dict[tuple[int, int], dict[int, int]] = {}
        for k, pair, d, kind in zip(*(rows.column(c).to_pylist() for c in ("step", "pair", "d", "kind")), strict=True):
            got.setdefault((k, kind), {})[pair] = d
        done = 0
        for k, (pair, symbol) in enumerate(tries):
            if scores.leaders(1) != [pair]:
                break
            made = got.get((k, 1), {}).get(pair, 0)
            changes = {p: d for p, d in got.get((k, 0), {}).items() if d > 0 or p in scores.pairs}
            scores.merge(pair, symbol, made, changes, got.get((k, 2), {}) if again else None)
            scores.pairs.pop(pair, None)
            merges.append((names[pair >> 32], names[pair & 0xFFFFFFFF]))
            known.add(names[symbol])
            steps.append((np.array([pair]), np.array([symbol])))
            done += 1
        for s in names[max([fresh, *(symbol + 1 for _, symbol in tries[:done])]):]:
            del number[s]
        del names[max([fresh, *(symbol + 1 for _, symbol in tries[:done])]):]
        if len(steps) >= FOLD_EVERY:
            table, steps = bpe._stored(table.mapInArrow(bpe._fold_task(steps), schema)), []
    tokens = list(dict.fromkeys([UNK, *base, *(joined(a, b) for a, b in merges)]))[:vocab_size]
    return WordPieceModel(merges, tokens, lowercase)


class _Encoder:
    """The vocabulary as a trie of characters; broadcast."""

    END = ""

    def __init__(self, model: WordPieceModel):
        self.ids, self.memo = model.vocab, {}
        self.first: dict = {}
        self.rest: dict = {}
        for token in model.tokens:
            node = self.rest if token.startswith(PREFIX) and len(token) > len(PREFIX) else self.first
            for c in token[len(PREFIX):] if node is self.rest else token:
                node = node.setdefault(c, {})
            node[self.END] = token

    def word(self, word: str) -> list[str]:
        out, at = [], 0
        while at < len(word):
            node, best, end = self.rest if at else self.first, None, at
            for i in range(at, len(word)):
                node = node.get(word[i])
                if node is None:
                    break
                if self.END in node:
                    best, end = node[self.END], i + 1
            if best is None or best == UNK:
                return [UNK]
            out.append(best)
            at = end
        return out

    def text(self, text: str | None) -> tuple[list[str], list[int]] | None:
        if text is None:
            return None
        toks: list[str] = []
        for w in text.split():
            got = self.memo.get(w)
            if got is None:
                if len(self.memo) >= bpe.MEMO_WORDS:
                    self.memo.clear()
                got = self.memo[w] = self.word(w)
            toks += got
        return toks, [self.ids[t] for t in toks]


def encoded(text, model: WordPieceModel) -> Column:
    """struct<tokens, ids> of a text column: null in, null out."""
    return bpe.token_udf(_Encoder(model))(bpe.preprocess(col_(text), model.lowercase, None))
