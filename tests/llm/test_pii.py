"""Personal data: base spans against the stated patterns, trees and thresholds on planted cases."""

import hashlib
import random
import time

import numpy as np
import pytest

import brute
from lexiforge.llm import pii
from lexiforge.llm.common import documents
from lexiforge.llm.queries import REGISTRY


def test_base_spans_of_random_text():
    r = random.Random(1)
    for _ in range(60_000):
        text = "".join(r.choice("a.@-+ 0123459(é)%") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == brute.pii_spans(text), text
    for _ in range(3000):
        text = " ".join(r.choice(["4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4.5.6.7.8.9", "300.1.1.1", "0001.2.3.255", "a@b.c@d.e.f", "@x.y", "+1 (743) 555-3824",
                                  "+123456789012345678", "12345678901234567890", "5500005555555559", "q@w", "..@-.-"]) + r.choice(["", ".", "@", "-", "1"]) for _ in range(6))
        assert pii.base_spans(text) == brute.pii_spans(text), text


@pytest.mark.parametrize("text", ["a" * 10**6, "1" * 10**6, "1." * 500_000, "1 " * 500_000, "a@" * 300_000, "@a.b" * 250_000, "+1" * 500_000, "a.b@c.d " * 120_000,
                                  "+" + "1 (" * 300_000, "1-1-1-1." * 120_000, "at (at) " * 120_000])
def test_long_texts_take_linear_time(text):
    began = time.time()
    model = {"bias": 0.0, "feature": [], "cut": [], "value": [], "threshold": np.full(4, 2.0)}
    list(pii._spans([text], model))
    list(pii.labelled(text))
    assert time.time() - began < 40


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in documents(spark, sf_dir).collect()}
    got = {r["doc_id"]: r for r in REGISTRY["op13_pii"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    added = 0
    for i, text in texts.items():
        base = brute.pii_spans(text or "")
        written = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        r = got[i]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(written.split(",") if base else []) <= set(spans)
        added += len(spans) - len(base)
    assert added <= 0.05 * sum(len(r["spans"].split(",")) for r in got.values() if r["spans"])


def test_boost_learns_interactions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = pii.boost(x[:3000], y[:3000])
    assert ((pii.probability(model, x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def _corpus(n, seed):
    r = random.Random(seed)

    def word():
        return "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))

    def phone():
        return f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"

    out = []
    for k in range(n):
        parts = [word() for _ in range(30)]
        parts.insert(r.randrange(30), r.choice([f"call {phone()}", f"mail {word()}@{word()}.com", f"paid {r.randint(10**6, 10**9)} EUR", f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)} 10:20:30",
                                                f"see {word()} (at) noon", f"no {r.randint(10**15, 10**16 - 1)}", f"v{r.randint(1, 9)}.{r.randint(256, 999)}.{r.randint(0, 9)}.{r.randint(0, 9)}"]))
        out.append((k, " ".join(parts)))
    return out


def test_model_adds_respelled_spans_and_leaves_others(spark):
    model = pii.train(spark.createDataFrame(_corpus(3000, 1), "doc_id long, text string"))
    assert model is not None and np.isfinite(model["threshold"][pii.PHONE])
    planted = [(i, f"{' '.join(t.split()[:5])} call ({200 + i}) 555-{4000 + i} and mail some.one (at) abc.com soon") for i, t in _corpus(50, 2)]
    found = pii.report(spark.createDataFrame(planted, "doc_id long, text string"), model).collect()
    assert np.mean(["phone" in r["spans"] for r in found]) > 0.9 and all(r["n_phone"] == 0 for r in found)
    clean = [(i, t) for i, t in _corpus(600, 3) if not pii.base_spans(t)]
    found = pii.report(spark.createDataFrame(clean, "doc_id long, text string"), model).collect()
    assert np.mean([r["spans"] == "" for r in found]) > 0.99
    text = pii.redacted(spark.createDataFrame([(1, "call (743) 555-3824 or a@b.cd now")], "doc_id long, text string"), model).first()["text"]
    assert text == "call [PHONE] or [EMAIL] now"
    again = pii.train(spark.createDataFrame(_corpus(3000, 1), "doc_id long, text string").repartition(7))
    assert (again["threshold"] == model["threshold"]).all()


def test_edges(spark):
    rows = [(None, "a@b.co"), (1, None), (2, ""), (3, "x" * 70_000 + " 1.2.3.4 😀 é@x.y é.a@x.y"), (3, "+1 (743) 555-3824"), (3, "+1 (743) 555-3824"), (4, "no data")]
    docs = spark.createDataFrame([(*x, "k", 1) for x in rows], "doc_id long, text string, spans string, n_email int").repartition(3)
    model = pii.train(docs)
    got = sorted((r["doc_id"] or 0, r["spans"]) for r in pii.report(docs, model).collect())
    assert got == sorted((i or 0, ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute.pii_spans(t or ""))) for i, t in rows)
    assert pii.train(docs.limit(0)) is None and pii.report(docs.limit(0), None).count() == 0
    assert pii.redacted(docs, model).columns == docs.columns and pii.redacted(docs, model).where("text is null").count() == 1
