"""The chain operator's tasks take many texts and matches at once; the plain version of each step agrees."""

import random
from itertools import accumulate

import numpy as np
import pyarrow as pa

from lexiforge.llm import chain_dedup as cd
from lexiforge.llm.words import by_key, many_tokens, pieces, tokens, whole_keys


def _texts(rnd):
    made = ["", "...", "one", "Ünïcode İstanbul ΣΑΣ", "a " * 5, "b " * 6, "c d e f g h i j k l m n o p q r s t u"]
    made += [" ".join(rnd.choice(["a", "B", "c,", "Ä", "ee"]) for _ in range(rnd.randint(0, 80))) for _ in range(60)]
    return [t.encode() for t in made] + [b"\xff bad \xc3 bytes here and there"]


def test_tokens_and_minimizers_of_many_texts():
    rnd = random.Random(4)
    for _ in range(5):
        texts = _texts(rnd)
        rnd.shuffle(texts)
        words, starts, ends, begins, first = many_tokens(texts)
        seeds = list(zip(*(c.tolist() for c in cd.text_minimizers(words, first)), strict=True))
        for i, text in enumerate(texts):
            h, s, e = tokens(text)
            lo, hi = first[i], first[i + 1]
            assert words[lo:hi].tolist() == h.tolist()
            assert (starts[lo:hi] - begins[i]).tolist() == s.tolist() and (ends[lo:hi] - begins[i]).tolist() == e.tolist()
            at, seed = cd.minimizers(h)
            assert [x[1:] for x in seeds if x[0] == i] == list(zip(at.tolist(), seed.tolist(), strict=True))


def test_texts_are_cut_into_pieces():
    assert list(pieces([3, 3, 3, 9, 1, 1], 6)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(pieces([], 6)) == []


def test_chains_of_many_keys():
    rnd = random.Random(5)
    rows = []
    for key in range(600):
        kind, p, q = rnd.randint(0, 3), rnd.randint(0, 50), rnd.randint(0, 50)
        for _ in range(rnd.randint(1, 8)):
            n = rnd.randint(0, 4)
            g = bytes(rnd.randint(1, 16) for _ in range(n))
            h = g if kind else bytes(rnd.randint(1, 16) for _ in range(n))
            rows.append((key, p, q, g, h, kind == 2))
            step = rnd.choice([1, 5, 29, 30, 31, 36, 37, 60])
            p, q = p + step, q + step + (rnd.choice([0, 0, 1, 7]) if kind < 3 else rnd.randint(-40, 40))
    rows = [r for r in rows if r[2] >= 0]
    key, pos, other, same = (np.array([r[i] for r in rows]) for i in (0, 1, 2, 5))
    k, x, y = cd.expanded(key, pos, other, [r[3] for r in rows], [r[4] for r in rows], same)
    found, sizes = cd.all_chains(k, x, y)
    ends = np.cumsum(sizes)
    got, plain = {}, {}
    for lo, hi in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        part = found[lo:hi]
        got.setdefault(int(k[part[0]]), set()).add((tuple(x[part].tolist()), tuple(y[part].tolist())))
    for r in rows:
        for a, b in zip(accumulate(r[3], initial=r[1]), accumulate(r[4], initial=r[2]), strict=True):
            if not r[5] or a > b:
                plain.setdefault(r[0], set()).add((a, b))
    want = {}
    for i, pairs in plain.items():
        xs, ys = [a for a, _ in sorted(pairs)], [b for _, b in sorted(pairs)]
        parts = {(tuple(xs[j] for j in c), tuple(ys[j] for j in c)) for c in cd.chains(xs, ys)}
        if parts:
            want[i] = parts
    assert got == want and len(want) > 100
    # positions that do not fit into one number together
    far = [1 << 30, (1 << 30) + 12]
    big = cd.expanded(np.array([1, 1, 9, 9]), np.array(far * 2), np.array(far * 2), [b""] * 4, [b""] * 4, np.zeros(4, dtype=bool))
    assert [c.tolist() for c in big] == [[1, 1, 9, 9], far * 2, far * 2]


def test_alignment_along_one_diagonal():
    rnd = random.Random(6)
    for _ in range(200):
        a = np.array([rnd.randint(0, 5) for _ in range(60)])
        b = a.copy()
        b[[rnd.randrange(60) for _ in range(rnd.randint(0, 6))]] = 9
        at = sorted(rnd.sample(range(5, 50), 4))
        want = sum(cd.edit_distance(a[p:q], b[p:q]) for p, q in zip(at[:-1], at[1:], strict=True) if not np.array_equal(a[p:q], b[p:q]))
        ends = cd._extend(a[:at[0]][::-1], b[:at[0]][::-1])[1] + cd._extend(a[at[-1] + 6:], b[at[-1] + 6:])[1]
        assert cd.align(a, b, at, at)[4] == want + ends


def test_whole_keys_agree_with_one_key_at_a_time():
    rnd = random.Random(7)
    keys = sorted(rnd.choice([1, 2, 3, 50, 51, 52, 53]) for _ in range(300))
    batches = [pa.RecordBatch.from_pydict({"k": keys[i:i + 7], "v": list(range(i, min(i + 7, 300)))}) for i in range(0, 300, 7)]
    want = [t.to_pydict() for t in by_key(iter(batches), ["k"])]
    for rows in (1, 20, 1000):
        got = []
        for t, first in whole_keys(iter(batches), ["k"], rows):
            ends = [*first[1:].tolist(), t.num_rows]
            got += [t.slice(lo, hi - lo).to_pydict() for lo, hi in zip(first.tolist(), ends, strict=True)]
        assert got == want


def test_a_text_repeated_by_many_rows_is_taken_apart_once(monkeypatch):
    monkeypatch.setattr(cd, "AT_ONCE", 100)
    z = cd.zstandard.ZstdCompressor()
    texts = [b"x" * 300, b"x" * 300, b"y" * 10, b"z" * 10, b"z" * 10]
    slices = [b"s" * 60] * 5
    got = list(cd._unpacked([z.compress(t) for t in texts], [z.compress(t) for t in slices]))
    rows = [(lo + i, t[w], p) for lo, t, which, parts in got for i, (w, p) in enumerate(zip(which, parts, strict=True))]
    assert rows == [(i, t, b"s" * 60) for i, t in enumerate(texts)]
    assert len(got) > 1 and sum(len(t) for _, t, _, _ in got) <= 5
