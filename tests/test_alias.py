"""Alias tables give every choice exactly its share of integer weight."""

import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import alias
from lexiforge.operators import generate as gen


@pytest.mark.parametrize("bounded", [True, False])
def test_shares_are_exact(spark, bounded):
    r = random.Random(4)
    rows = [("a", f"v{k:03d}", 99.0 if k == 7 else 1 / 99) for k in range(99)]  # one weight of 0.99
    rows += [("b", f"v{k:03d}", r.choice([0.0, None, 1.0, 1.0, 5.5, r.random() * 40])) for k in range(200)]
    rows += [("c", "only", 3.0), ("d", "x", 1.0), ("d", "y", 1.0), ("e", "never", 0.0)] + [("f", f"{k}", float(k % 3 == 0) * 50 + 0.01) for k in range(30)]
    df = spark.createDataFrame(rows, "entity string, value string, weight double")
    weights = {(x["entity"], x["value"]): x["_w"] for x in alias.integer_weights(df, "weight", ["entity"]).collect()}
    table = alias.alias_table(df, "value", "weight", ["entity"], bounded).collect()
    total, n = defaultdict(int), defaultdict(int)
    for (e, _), w in weights.items():
        total[e] += w
        n[e] += 1
    got, slots = defaultdict(Fraction), defaultdict(list)
    for x in table:
        e = x["entity"]
        own = round(x["own"] * total[e])
        assert x["n"] == n[e] and 0 <= own <= total[e] and abs(own - x["own"] * total[e]) < 1e-3
        got[e, x["choice"]] += own
        got[e, x["alias"]] += total[e] - own
        slots[e].append(x["slot"])
    assert {k: v for k, v in got.items() if v} == {k: w * n[k[0]] for k, w in weights.items()}
    assert all(sorted(s) == list(range(n[e])) for e, s in slots.items()) and "e" not in slots


def test_draws(spark):
    df = spark.createDataFrame([("x", 99.0), ("y", 0.5), ("z", 0.5)], "value string, weight double")
    table = alias.alias_table(df, "value", "weight", bounded=True)
    s = spark.range(20_000).select("id", (F.col("id") / 20_000).alias("u"))
    got = {r["choice"]: r["count"] for r in alias.alias_choice(s, "u", table).groupBy("choice").count().collect()}
    assert got["x"] == 19_800 and got["y"] + got["z"] == 200 and abs(got["y"] - 100) <= 1
    assert alias.alias_choice(s.withColumn("u", F.lit(None).cast("double")), "u", table).where("choice is not null").count() == 0
    assert alias.alias_choice(s, "u", alias.alias_table(df.limit(0), "value", "weight", bounded=True)).where("choice is null").count() == 20_000


def test_generated_values_follow_weights(spark):
    t = spark.createDataFrame([(0, "{item}!", None)], "template_index int, template string, weight double")
    ents = spark.createDataFrame([("item", "rare", 1.0), ("item", "common", 99.0)], "entity string, value string, weight double")
    g = gen.Grammar(t, ents, ("item",))
    recs = gen.generate(spark, g, [("train", 4000)], 3, ("lm",))
    got = {r["text"]: r["count"] for r in recs.groupBy("text").count().collect()}
    assert set(got) == {"rare!", "common!"} and 15 <= got["rare!"] <= 75
