"""Spelling variants against comparing every two words, small leaves and anagrams included."""

import random

import numpy as np
import pytest

import brute
from lexiforge.llm import spelling_groups as sg
from lexiforge.llm.common import documents
from lexiforge.llm.queries import REGISTRY


def _got(rows):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    stems = ["".join(r.choice("abcdeé") for _ in range(r.randint(4, 8))) for _ in range(120)]
    stems += ["".join(r.sample("abcdefg", 7)) for _ in range(150)]  # anagrams: equal vectors
    texts = []
    for _ in range(400):
        w = r.choice(stems)
        at = r.randrange(len(w))
        w = r.choice([w, w, w[:at] + w[at + 1:], w[:at] + r.choice("abcdéxÿ") + w[at:], w[:at] + r.choice("abcdéx") + w[at + 1:], w.upper()])
        texts.append(" ".join([w] * r.randint(3, 60)))
    return list(enumerate(texts))


def _limits(words):
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("leaf", [sg.LEAF, 20, 3])
def test_variants(spark, rows, leaf, monkeypatch):
    monkeypatch.setattr(sg, "SMALL", 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.variants(_limits(brute.spelling_words(rows)))
    assert _got(sg.variants(docs, leaf=leaf).collect()) == want
    assert sum(w[3] for w in want.values()) > 50 and any(w[1] not in (w[0], k) for k, w in want.items())


def test_query(spark, small_sf):
    docs = documents(spark, small_sf)
    words = _limits(brute.spelling_words([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert _got(REGISTRY["op12_spelling_groups"](spark, small_sf).collect()) == brute.variants(words)


def test_one_edit_of_letter_matrices():
    r = random.Random(4)
    for _ in range(2000):
        a = "".join(r.choice("ab") for _ in range(5))
        b = "".join(r.choice("ab") for _ in range(r.choice([5, 6])))
        codes = [np.array([[ord(c) for c in w]]) for w in (a, b)]
        assert bool(sg.one_edit(*codes)[0]) == brute.one_edit(a, b)


def test_edges(spark):
    long = "ab" * 30_000
    rows = [(None, "Straße straße STRAßE strasse"), (None, None), (1, ""), (2, f"{long} {long} {long} {long}b {long}b {long}b"), (3, "word " * 50 + "wore " * 3 + "words " * 9),
            (3, "word " * 50), (4, "12345 ... ÀÉÎ ÀÉÎ 😀x "), (5, "abcde abcde abcde bacde bacde bacde"), (6, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa")]
    docs = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, n long, word string").repartition(3)
    want = brute.variants({w: n for w, n in brute.spelling_words(rows).items() if n >= 1})
    assert _got(sg.variants(docs, min_length=1, min_count=1).collect()) == want
    assert sg.variants(docs.limit(0)).count() == 0
