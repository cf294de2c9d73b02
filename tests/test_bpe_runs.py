"""BPE training over whole lines: few rounds, and the merges of a plain sequential trainer."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_bpe import _sequential

from lexiforge.operators import bpe, bpe_runs


class _LocalRuns:
    """The same tasks over rows at hand, without Spark."""

    def __init__(self, units, base):
        number = {s: i for i, s in enumerate(base)}
        flat = np.array([x for u in units for x in [*(number[c] for c in u), number["</w>"], -1]])
        self.rows = list(bpe._packed(flat, np.array(list(units.values()))))

    def counts(self, track):
        got = next(bpe._counts_task([])(iter(self.rows)))
        keys, n = (np.array(c) for c in got.columns)
        top = np.argsort(-n, kind="stable")[:track]
        return keys[top], n[top]

    def runs(self, hot, limit):
        got = bpe_runs._summed_runs([pa.Table.from_batches([b]) for b in bpe_runs.runs_task(hot)(iter(self.rows))])
        flat = bpe_runs.ended(got["run"])
        return None if limit is not None and len(flat) - len(got) > limit else (flat, got["n"].to_numpy())

    def make(self, hot, layers):
        self.rows = list(bpe_runs.fold_task(hot, layers)(iter(self.rows)))


def test_lines_train_in_few_rounds(spark):
    """Lines that share long passages: hundreds of merges, nearly all of them with neighbours as frequent."""
    r = random.Random(5)
    syllables = ["th", "er", "on", "an", "re", "the ", "and ", "ing ", "tion", "of "]
    passages = ["".join(r.choice(syllables) for _ in range(40)) for _ in range(12)]
    lines = [" ".join(r.sample(passages, 3)) + "".join(r.choice(syllables) for _ in range(10)) for _ in range(40)]
    units = bpe.training_units(spark.createDataFrame([(t,) for t in [*lines, None, ""]], "text string"), "text", unit="line")
    merges, tokens = _sequential(Counter(lines), 400, 2)
    model = bpe.train(units, 400, 2, unit="line")
    assert len(merges) > 300 and model.merges == merges and model.tokens == tokens
    assert model.stats["rounds"] <= 6


@pytest.mark.parametrize(("held", "fewest", "share", "track"), [
    (10**6, 256, 0.25, 10**6), (10**6, 1, 0.5, 10**6), (10**6, 1, 0.9, 60), (40, 256, 0.25, 10**6), (15, 4, 0.6, 25)])
def test_many_small_line_trainings(monkeypatch, held, fewest, share, track):
    """Ties, strings made in several ways, runs that do not fit and pairs that are not held."""
    for name, value in (("HELD_SYMBOLS", held), ("FEWEST_HOT", fewest), ("SHARE", share), ("LEAST_SHARE", min(share, 1 / 64) if fewest > 1 else share)):
        monkeypatch.setattr(bpe_runs, name, value)
    r = random.Random(held + fewest + track)
    short = 0
    for k in range(60):
        letters = "ab" if k % 3 == 0 else "abc" if k % 3 == 1 else "abcdefgh"
        units = {"".join(r.choice(letters) for _ in range(r.randint(1, 9 if k % 2 else 50))): r.choice([1, 1, 2, 3, 9, 50]) for _ in range(r.randint(3, 50))}
        base = sorted({c for u in units for c in u} | {"</w>"})
        size, least = len(base) + 1 + r.choice([5, 30, 200]), r.choice([1, 2])
        merges, _ = _sequential(units, size, least)
        try:
            got, rounds = bpe_runs.learned(_LocalRuns(units, base), base, size, least, track)
        except ValueError:
            short += 1  # more pairs of one frequency than may be tracked
            continue
        assert got == merges, (k, units, size, least)
        assert rounds <= len(merges) + 1
    assert short < 30


def test_runs_are_whole_and_counted(monkeypatch):
    """Runs end at cold pairs and at the ends of units; a task that holds many sends them in parts."""
    row = next(bpe._packed(np.array([0, 1, 2, -1, 5, 0, 1, 2, 0, 1, -1, 4, -1, 2, 0, -1]), np.array([3, 2, 9, 5])))
    hot = np.array([0 << 32 | 1, 1 << 32 | 2])
    for held, batches in ((bpe_runs.TASK_SYMBOLS, 1), (0, 2)):
        monkeypatch.setattr(bpe_runs, "TASK_SYMBOLS", held)
        got = list(bpe_runs.runs_task(hot)(iter([row, row])))
        assert len(got) == batches
        total = Counter()
        for b in got:
            for run, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[tuple(np.frombuffer(run, dtype=np.int32).tolist())] += n
        assert total == {(0, 1, 2): 10, (0, 1): 4}
    assert not list(bpe_runs.runs_task(np.array([7 << 32 | 7]))(iter([row])))
    made = [(np.array([0 << 32 | 1]), np.array([8])), (np.array([8 << 32 | 2]), np.array([9]))]
    (folded,) = bpe_runs.fold_task(hot, made)(iter([row]))
    assert np.frombuffer(folded.column(0)[0].as_py(), dtype=np.int32).tolist() == [9, -1, 5, 9, 8, -1, 4, -1, 2, 0, -1]
