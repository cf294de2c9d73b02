"""The Markov models of the secret scan against a plain scorer, and tokens of any length."""

import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from lexiforge.llm import secret_scan as ss


def _codes(token):
    return [ss.ALPHABET.find(c) + 1 for c in token]


def _table(samples):
    counts = Counter()
    for token, label, n in samples:
        c = _codes(token)
        for a, b in zip(c, c[1:]):
            counts[label, a, b] += n
    out = {}
    for a in range(ss.SIZE):
        sums = [sum(counts[k, a, b] for b in range(ss.SIZE)) for k in (0, 1)]
        for b in range(ss.SIZE):
            p0, p1 = (0.05 / ss.SIZE + 0.95 * (counts[k, a, b] / sums[k] if sums[k] else 1 / ss.SIZE) for k in (0, 1))
            out[a, b] = math.log(p1 / p0)
    return out


def _score(token, table):
    c = _codes(token)
    r = [table[a, b] for a, b in zip(c, c[1:])]
    w = ss.MIN_LENGTH - 1
    return max(sum(r) / len(r), max(sum(r[i:i + w]) for i in range(len(r) - w + 1)) / (2 * w))


def test_against_a_plain_scorer(spark):
    r = random.Random(2)
    samples = [("".join(r.choice(ss.ALPHABET) for _ in range(r.randint(2, 40))), 1, r.randint(1, 5)) for _ in range(300)]
    samples += [("_".join(r.choice(["alpha", "beta", "Max", "count", "2024"]) for _ in range(4)), 0, r.randint(1, 5)) for _ in range(300)]
    model = ss.train(spark.createDataFrame(samples, "token string, label int, n long"))
    table = _table(samples)
    assert all(abs(model[a * ss.SIZE + b] - table[a, b]) < 1e-9 for a in range(ss.SIZE) for b in range(ss.SIZE))
    texts = []
    for k in range(400):
        words = ["".join(r.choice(ss.ALPHABET) for _ in range(r.randint(5, 45))) if r.random() < 0.5 else "_".join(["alpha", "beta", "Max"] * r.randint(1, 6)) for _ in range(6)]
        texts.append((k, " ".join(words)))
    got = ss.scan(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    for row in got:
        base = [s for s in row["secret_spans"] if s["kind"] < 3]
        want = {(m.start(), m.end()) for m in re.finditer(ss.TOKEN, row["text"])
                if not any(b["start"] < m.end() and m.start() < b["end"] for b in base) and _score(m[0], table) >= ss.THRESHOLD}
        assert {(s["start"], s["end"]) for s in row["secret_spans"] if s["kind"] == 3} == want


def test_long_tokens_take_linear_time(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(1, "".join(r.choice(ss.ALPHABET) for _ in range(1_000_000))), (2, "x" * 300_000)], "doc_id long, text string")
    began = time.time()
    assert len(ss.train(ss.samples_of(docs))) == ss.SIZE**2
    samples = [("".join(r.choice(ss.ALPHABET[:62]) for _ in range(40)), 1, 1) for _ in range(500)] + [("alpha_beta_gamma_delta", 0, 500)]
    model = ss.train(spark.createDataFrame(samples, "token string, label int, n long"))
    rows = {x["doc_id"]: x for x in ss.report(docs, model).collect()}
    assert rows[1]["n_markov"] == 1 and rows[1]["spans"] == "markov:0:1000000"
    assert time.time() - began < 120


def test_samples_take_all_words(spark):
    docs = spark.createDataFrame([(1, " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)))], "doc_id long, text string")
    tokens = {x["token"] for x in ss.samples_of(docs).where(F.col("label") == 0).collect()}
    assert {"_WORDRH_", "_wordrh_", "-wordrh-", "/wordrh/", "WordrhWordrh", "wordrh"} <= tokens
