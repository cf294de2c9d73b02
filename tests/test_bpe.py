"""BPE goldens (hand-worked in FIXTURES.md) and training invariants."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiforge.operators import bpe
from lexiforge.plans import queries


def units_of(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return bpe.training_units(df, "text", lowercase=True)


def test_train_golden(spark):
    model = bpe.train(units_of(spark, ["aab", "aab", "ab"]), vocab_size=8, min_frequency=1)
    assert model.merges == [("a", "b"), ("ab", "</w>"), ("a", "ab</w>")]
    assert model.vocab == {"<unk>": 0, "</w>": 1, "a": 2, "b": 3, "ab": 4, "ab</w>": 5, "aab</w>": 6}


def test_encode_golden(spark):
    model = bpe.train(units_of(spark, ["aab", "aab", "ab"]), vocab_size=8, min_frequency=1)
    df = spark.createDataFrame([("aab ab b c",), ("",), (None,)], "text string")
    by = {r["text"]: r for r in bpe.apply_tokenizer(df, ["text"], model).collect()}
    assert by["aab ab b c"]["text_tokens"] == ["aab</w>", "ab</w>", "b", "c"]
    assert by["aab ab b c"]["text_ids"] == [6, 5, 3, 0]
    assert by[""]["text_tokens"] == []
    assert by[None]["text_tokens"] is None and by[None]["text_ids"] is None


def test_foreign_table(spark):
    model = bpe.BpeModel(merges=[("abc", "d"), ("a", "b"), ("ab", "c")], tokens=["<unk>"])
    check = bpe.table_check(model.merges_frame(spark)).first()
    assert check["ok"] == 0
    df = spark.createDataFrame([("abcd",)], "text string")
    toks = df.select(bpe.encoded(F.col("text"), model)["tokens"].alias("t")).first()["t"]
    assert toks == ["abcd"]


def _merge(seq: tuple, pair: tuple) -> tuple:
    out, skip = [], False
    for a, b in zip(seq, seq[1:] + (None,)):
        if skip:
            skip = False
        elif (a, b) == pair:
            out.append(a + b)
            skip = True
        else:
            out.append(a)
    return tuple(out)


def _sequential(words_freq, vocab_size, min_freq):
    """Plain single-process trainer over symbol tuples (test oracle): recount every pair,
    merge the most frequent (ties: smallest pair), repeat."""
    table = Counter({tuple(w) + ("</w>",): f for w, f in words_freq.items()})
    tokens = ["<unk>"] + sorted({s for k in table for s in k} | {"</w>"})
    merges = []
    while len(tokens) < vocab_size:
        stats = Counter()
        for seq, f in table.items():
            stats.update({p: 0 for p in zip(seq, seq[1:])})
            for p in zip(seq, seq[1:]):
                stats[p] += f
        ok = sorted((-f, p) for p, f in stats.items() if f >= min_freq)
        if not ok:
            break
        best = ok[0][1]
        merges.append(best)
        nxt = Counter()
        for seq, f in table.items():
            nxt[_merge(seq, best)] += f
        table = nxt
        if "".join(best) not in tokens:
            tokens.append("".join(best))
    return merges, tokens[:vocab_size]


def test_batched_training_equals_sequential(spark, small_sf):
    docs = spark.read.parquet(f"{small_sf}/documents.parquet").limit(40)
    units = bpe.training_units(docs, "text", lowercase=True)
    wf = {r["unit"]: r["freq"] for r in units.collect()}
    n_alpha = len({c for w in wf for c in w}) + 2
    merges, tokens = _sequential(wf, n_alpha + 30, 2)
    model = bpe.train(units, n_alpha + 30, 2, track=300)
    assert model.merges == merges
    assert model.tokens == tokens


def test_training_deterministic(spark, small_sf):
    docs = spark.read.parquet(f"{small_sf}/documents.parquet")
    units = bpe.training_units(docs, "text", lowercase=True)
    a = bpe.train(units, 90, 2)
    b = bpe.train(bpe.training_units(docs.repartition(5), "text", lowercase=True), 90, 2)
    assert a.merges == b.merges and a.tokens == b.tokens


def test_model_roundtrip(spark, tmp_path):
    from lexiforge.sources import io

    model = bpe.train(units_of(spark, ["aab", "aab", "ab"]), vocab_size=8, min_frequency=1)
    io.save_tokenizer(spark, model, str(tmp_path / "tok"))
    back = io.load_tokenizer(spark, str(tmp_path / "tok"))
    assert back.merges == model.merges and back.tokens == model.tokens


def _encode_plain(word, merges):
    ranks = {}
    for i, p in enumerate(merges):
        ranks.setdefault(p, i)
    seq = tuple(word) + ("</w>",)
    while True:
        ranked = [(ranks[p], p) for p in zip(seq, seq[1:]) if p in ranks]
        if not ranked:
            return list(seq[:-1] if seq[-1] == "</w>" else seq)
        seq = _merge(seq, min(ranked)[1])


def test_any_text_trains_and_encodes(spark):
    """Private-use characters, spelled-out markers, repeats and overlapping pairs are ordinary text."""
    texts = ["a\ue000b\ue001c a\ue000b", "</w> x</w>y aaaa aaaaa", "<unk> abab ababab \ue001\ue001\ue001", "😀😀 é̂é̂ aaaa"]
    units = units_of(spark, texts)
    wf = {r["unit"]: r["freq"] for r in units.collect()}
    merges, tokens = _sequential(wf, 60, 1)
    model = bpe.train(units, 60, 1)
    assert model.merges == merges and model.tokens == tokens
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in bpe.apply_tokenizer(df, ["text"], model).collect():
        want = [t for w in r["text"].lower().split() for t in _encode_plain(w, merges)]
        assert r["text_tokens"] == want
        assert r["text_ids"] == [model.vocab.get(t, 0) for t in want]
    stats = {(r["l"], r["r"]): r["freq"] for r in bpe.pair_stats(bpe.symbol_arrays(units_of(spark, ["ab\ue001c"]))).collect()}
    assert stats == {("a", "b"): 1, ("b", "\ue001"): 1, ("\ue001", "c"): 1, ("c", "</w>"): 1}


class _LocalUnits(bpe._UnitTable):
    """The same tasks over one batch, without Spark: many small trainings in little time."""

    def __init__(self, words_freq, base):
        number = {s: i for i, s in enumerate(base)}
        seqs = [[*(number[c] for c in w), number["</w>"]] for w in words_freq]
        self.batch = pa.RecordBatch.from_arrays([pa.array(seqs, pa.list_(pa.int32())), pa.array(list(words_freq.values()), pa.int64())], names=["seq", "freq"])
        self.steps = []

    def counts(self, track):
        got = next(iter(bpe._counts_task(self.steps)(iter([self.batch]))))
        keys, n = (np.array(c) for c in got.columns)
        top = np.argsort(-n, kind="stable")[:track]
        return keys[top], n[top]

    def apply(self, keys, symbols, fresh, again, pairs):
        got = list(bpe._changes_task(self.steps, keys, symbols, fresh, again, pairs.keys if pairs.floor else None, pairs.asked())(iter([self.batch])))
        self.steps.append((keys, symbols))
        pair, d, kind, beside = [np.array(c) for c in got[0].columns] if got else [np.empty(0, dtype=np.int64)] * 4
        new = (pair >> 32 >= fresh) | (pair & 0xFFFFFFFF >= fresh)
        use = (~new & (kind == 0)) | (kind > 1) | (d > pairs.floor)
        return [c[use] for c in (pair, d, kind, beside)]


@pytest.mark.parametrize("track", [10**6, 60, 25])
def test_many_small_trainings(track):
    """Few letters and low counts: ties, runs, strings made in several ways and pairs that were dropped."""
    r = random.Random(track)
    short = 0
    for k in range(250):
        letters = "ab" if k % 3 == 0 else "abc" if k % 3 == 1 else "abcdefgh"
        words = ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(r.randint(3, 60))]
        wf = {w: r.choice([1, 1, 2, 3, 9, 50]) for w in words}
        base = sorted({c for w in wf for c in w} | {"</w>"})
        size, least = len(base) + 1 + r.choice([5, 30, 200]), r.choice([1, 2])
        merges, _ = _sequential(wf, size, least)
        try:
            got, rounds = bpe._learned(_LocalUnits(wf, base), base, size, least, track)
        except ValueError:
            short += 1  # more pairs of one frequency than may be tracked
            continue
        assert got == merges, (k, wf, size, least)
        assert rounds <= len(merges) + 1
    assert short < 200


def test_strings_made_in_two_ways(spark):
    """ab+c and a+bc make one symbol; counts of its pairs stay exact."""
    wf = {"abc": 9, "ab": 8, "bcd": 12, "abcd": 5, "xabc": 4, "xbc": 7, "abcx": 6}
    units = spark.createDataFrame(list(wf.items()), "unit string, freq bigint")
    merges, tokens = _sequential(wf, 40, 1)
    model = bpe.train(units, 40, 1)
    assert model.merges == merges and model.tokens == tokens


def test_ids_beyond_4096_tokens(spark):
    tokens = ["<unk>", "</w>"] + [chr(0x4E00 + i) for i in range(5000)]
    model = bpe.BpeModel(merges=[], tokens=tokens, lowercase=False)
    df = spark.createDataFrame([(chr(0x4E00 + 4900) + chr(0x4E00) + "z",)], "text string")
    assert bpe.apply_tokenizer(df, ["text"], model).first()["text_ids"] == [4902, 2, 0]


def test_foreign_merge_order(spark):
    """A new pair of a lower rank waits until the pair in hand is merged everywhere."""
    merges = [("ab", "a"), ("a", "b"), ("b", "ab"), ("ab", "ab")]
    model = bpe.BpeModel(merges=merges, tokens=["<unk>"])
    df = spark.createDataFrame([("ababab",), ("babab",), ("aabab",)], "text string")
    for r in df.select("text", bpe.encoded(F.col("text"), model)["tokens"].alias("t")).collect():
        assert r["t"] == _encode_plain(r["text"], merges)


def test_registered_model_goes_to_the_declared_vocabulary(spark, tmp_path):
    """The registered queries' model against a sequential trainer, on a table whose pairs run out below 10,000."""
    r = random.Random(21)
    words = ["".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(60)]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words * 2)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    merges, _ = _sequential({w: 2 * words.count(w) for w in words}, 10_000, 2)
    assert len(merges) > 160
    assert queries.bpe_model(spark, str(tmp_path)).merges == merges


def test_unit_table_rows_hold_many_units(spark):
    """A row of the written table holds many units; long ones have a row of their own, and folding keeps every unit."""
    words = {"".join(p): i % 5 + 1 for i, p in enumerate(itertools.product("abcdef", repeat=4))}
    words["ab" * 100_000] = 7
    units = spark.createDataFrame(list(words.items()), "unit string, freq bigint")
    base = sorted({"</w>", *"abcdef"})
    letters = [(ord(s), i) for i, s in enumerate(base) if len(s) == 1]
    table = bpe._UnitTable(units, np.array([p for p, _ in letters]), np.array([i for _, i in letters]), base.index("</w>"))
    assert table.table.count() < 20

    def held(t):
        got = []
        for batch in t.toArrow().to_batches():
            for flat, freq in bpe._flat(batch):
                seqs = np.split(flat, np.flatnonzero(flat < 0) + 1)[:-1]
                got += [("".join(names[x] for x in s[:-2]), int(n)) for s, n in zip(seqs, freq, strict=True)]
        return dict(got)

    names = [*base, "ab"]
    assert held(table.table) == words
    step = (np.array([base.index("a") << 32 | base.index("b")]), np.array([len(base)]))
    folded = table.table.mapInArrow(bpe._fold_task([step]), table.SCHEMA)
    assert held(folded) == words
    symbols = sum(int((flat >= 0).sum()) for b in folded.toArrow().to_batches() for flat, _ in bpe._flat(b))
    assert symbols == sum(len(w) + 1 - w.count("ab") for w in words)


def test_a_task_answers_once_for_all_its_rows():
    """Changed counts are added up in the task: one batch leaves it, not one a row."""
    rows = [*bpe._packed(np.array([0, 1, 2, -1] * 3), np.array([1, 2, 3])), *bpe._packed(np.array([0, 1, -1, 3, 0, 1, -1]), np.array([4, 5]))]
    task = bpe._changes_task([], np.array([1]), np.array([9]), 9, np.empty(0, dtype=np.int64), None, [np.empty(0, dtype=np.int64)] * 2)
    got = list(task(iter(rows)))
    assert len(got) == 1
    assert {(p >> 32, p & 0xFFFFFFFF): d for p, d in zip(*(got[0].column(c).to_pylist() for c in (0, 1)))} == {
        (0, 1): -15, (1, 2): -6, (9, 2): 6, (3, 0): -5, (3, 9): 5}


def test_encoded_texts_leave_in_slices(spark):
    """A batch of long texts never becomes tokens as a whole, in either tokenizer; normalised texts neither."""
    texts = ["ab cd " * 30_000, None, "", "ab", "cd ab " * 50_000, "ab"]
    encoder = bpe._Encoder(bpe.BpeModel([("a", "b")], ["<unk>", "ab"], lowercase=False))
    parts = list(bpe._token_slices(pa.array(texts), encoder.text))
    assert len(parts) > 1 and max(len(p) for p in parts) < len(texts)
    assert [(x["tokens"], x["ids"]) for p in parts for x in p.to_pylist()] == [encoder.text(t) or (None, None) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r["i"]: r["n"] for r in df.select("i", F.coalesce(F.size(bpe.encoded("t", bpe.BpeModel([], ["<unk>"]))["ids"]), F.lit(-1)).alias("n")).collect()}
    assert got == {0: 120_000, 1: -1, 2: 0, 3: 2, 4: 200_000, 5: 2}
    assert spark.createDataFrame([("é",), (None,), ("a",)], "t string").select(bpe.normalize_udf("NFC")("t").alias("t")).collect() == [("é",), (None,), ("a",)]


def test_finder_agrees_with_a_plain_search(monkeypatch):
    """Places of pairs, by table and by search, in rows whose symbols are above those of the pairs too."""
    rng = np.random.default_rng(3)
    for cells in (1 << 20, 0):
        monkeypatch.setattr(bpe, "TABLE", cells)
        for _ in range(50):
            flat = np.concatenate([rng.integers(0, 9, 60), [-1], rng.integers(0, 4, 20), [-1]])
            keys = np.unique(rng.integers(0, 6, 7) << 32 | rng.integers(0, 6, 7))
            at, which = bpe._Finder(keys).every(flat)
            want = [i for i in range(len(flat) - 1) if flat[i] >= 0 and flat[i + 1] >= 0 and flat[i] << 32 | flat[i + 1] in keys]
            assert at.tolist() == want
            assert keys[which].tolist() == [int(flat[i] << 32 | flat[i + 1]) for i in want]
    assert bpe._Finder(np.array([0])).places(np.array([0, 0, 0, -1, 0, 0, -1]))[0].tolist() == [0, 4]


def test_words_are_counted_in_the_tasks(spark, monkeypatch):
    """A task sends a word once, unless it holds too many; the units stay those of a plain split."""
    texts = ["b a A", None, "", "a c b"]
    rows = lambda: iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])
    (got,) = bpe._word_counts(rows())
    assert dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)) == {"b": 2, "a": 2, "A": 1, "c": 1}
    monkeypatch.setattr(bpe, "WORDS_HELD", 1)
    assert sum(b.num_rows for b in bpe._word_counts(rows())) == 6
    units = bpe.training_units(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    assert {tuple(r) for r in units.collect()} == {("a", 3), ("b", 2), ("c", 1)}


def test_no_more_pairs_are_dropped_than_must_be():
    empty = np.empty(0, dtype=np.int64)
    pairs = bpe._Pairs(np.arange(80), np.arange(1, 81), 0, ["a"] * 120, {"a": 0})
    new = np.arange(80, 110)
    pairs.update(new, new + 1, np.zeros(30, dtype=np.int32), np.zeros(30, dtype=np.int64), empty, 100)
    assert pairs.floor == 23 and pairs.n.min() == 24 and len(pairs.n) == 87


def test_units_without_a_pair_are_copied_only_if_asked_for():
    rnd = np.random.default_rng(3)
    for _ in range(50):
        units = [rnd.integers(0, 4, size=rnd.integers(0, 6)).tolist() for _ in range(12)]
        flat, freq = np.array([x for u in units for x in [*u, -1]]), np.arange(12)
        finder = bpe._Finder(np.array([0 << 32 | 1, 2 << 32 | 2]))
        has = [any(p in ((0, 1), (2, 2)) for p in zip(u, u[1:], strict=False)) for u in units]
        want = [([x for u, h in zip(units, has, strict=True) if h == w for x in [*u, -1]], [i for i, h in enumerate(has) if h == w]) for w in (False, True)]
        rest, rest_freq, some, some_freq = bpe._parted(flat, freq, finder, True)
        assert [(rest.tolist(), rest_freq.tolist()), (some.tolist(), some_freq.tolist())] == want
        rest, rest_freq, some, some_freq = bpe._parted(flat, freq, finder, False)
        assert not len(rest) and not len(rest_freq) and (some.tolist(), some_freq.tolist()) == want[1]
