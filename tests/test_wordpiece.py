"""WordPiece against a plain trainer and plain longest match."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import wordpiece as wp


def _plain(words_freq, vocab_size, min_freq):
    table = Counter({(w[0], *("##" + c for c in w[1:])): f for w, f in words_freq.items() if w})
    tokens = ["[UNK]", *sorted({s for k in table for s in k})]
    merges = []
    while len(tokens) < vocab_size:
        pairs, symbols = Counter(), Counter()
        for seq, f in table.items():
            for s in seq:
                symbols[s] += f
            for p in zip(seq, seq[1:]):
                pairs[p] += f
        able = sorted((-n / (float(symbols[a]) * float(symbols[b])), (a, b)) for (a, b), n in pairs.items() if n >= min_freq)
        if not able:
            break
        a, b = able[0][1]
        merges.append((a, b))
        new = Counter()
        for seq, f in table.items():
            out, i = [], 0
            while i < len(seq):
                if seq[i:i + 2] == (a, b):
                    out.append(a + b[2:])
                    i += 2
                else:
                    out.append(seq[i])
                    i += 1
            new[tuple(out)] += f
        table = new
        if a + b[2:] not in tokens:
            tokens.append(a + b[2:])
    return merges, tokens[:vocab_size]


@pytest.mark.parametrize("letters,n,seed", [("ab", 25, 1), ("abcde", 60, 2), ("abcdefgh😀é#", 80, 3)])
def test_train(spark, letters, n, seed):
    r = random.Random(seed)
    wf = {"".join(r.choice(letters) for _ in range(r.randint(1, 8))): r.choice([1, 2, 3, 9, 40]) for _ in range(n)}
    units = spark.createDataFrame([*wf.items(), ("", 7)], "unit string, freq long")
    for size, least in ((len(letters) * 2 + 25, 2), (10_000, 30)):
        merges, tokens = _plain(wf, size, least)
        model = wp.train(units, size, least, speculate=6)
        assert model.merges == merges and model.tokens == tokens
    assert wp.train(units, 3).merges == [] and len(wp.train(units, 3).tokens) == 3
    assert wp.train(units.limit(0), 10).tokens == ["[UNK]"]


def test_encode(spark):
    model = wp.WordPieceModel([], ["[UNK]", "a", "##b", "ab", "##bc", "##c", "abc", "##", "#", "#x"])
    texts = ["abc abbc abcb ABC", "xa a##", "## #x #xb", "", "  ", None, "[UNK] ab"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", wp.encoded(F.col("t"), model).alias("e")).collect()
    want = {0: ["abc", "ab", "##bc", "abc", "##b", "abc"], 1: ["[UNK]", "[UNK]"], 2: ["##", "#x", "#x", "##b"], 3: [], 4: [], 5: None, 6: ["[UNK]", "ab"]}
    assert {r["i"]: r["e"] and r["e"]["tokens"] for r in got} == want
    assert all(r["e"]["tokens"] is None or r["e"]["ids"] == [model.vocab[t] for t in r["e"]["tokens"]] for r in got)
