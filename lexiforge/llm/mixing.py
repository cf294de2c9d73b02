"""Mixing sources to target weights by pivotal dependent rounding (op3); DataFrame functions only.

Every document of a source starts with the same fractional number of copies, target / source
size.  The integral part is taken outright; the fractional parts are rounded dependently: two
documents are paired and words of mass are moved from one to the other, at random in either
direction, until one of the two has zero or one copy.  The direction is drawn so that every
expected copy count is kept, and the moved mass is in words, so the words of the source stay equal.
Pairs are folded within blocks of about FANIN documents, the large ones first so that small ones
settle the rest; the blocks' single residuals are folded again up a tree of the same fan-in, so no
task ever holds more than a block.  The one residual left per source goes to the nearer whole number,
and one document of its block is flipped where that brings the source nearer to its target.

Sources in code-point order (null last) weigh ``weights``, repeating, and share ``share`` times all
words; a target stops at ``cap`` times its source's words, the excess is reshared by weight.

Defined results: null text has size 0 and is taken 0 times; null sources are one source; repeated
rows are rounded one by one; an empty table gives no rows.  Every draw is a hash of the seed and the
row's key, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import unit, written
from lexiforge.operators.indexing import dense_index

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
FANIN = 64
WORD = r"[^\x20\x09-\x0D]+"
_NEAR = 1e-9
_ITEM = "struct<doc_id:{id},r:int,size:bigint,p:double>"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _sources(light: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, n, w, target): water filling by rounds of one-row aggregates."""
    src = light.groupBy("source").agg(F.sum("size").alias("source_size"),
                                      F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    src = dense_index(src.withColumn("_none", F.col("source").isNull()), ["_none", "source"], name="pos")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    src = written(src.select("source", "source_size", "n", cycle[(F.col("pos") % len(weights)).cast("int")].alias("w")), "mix-sources")
    total = float(src.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = (F.col("source_size") * cap <= F.col("w") * level) if capped >= 0 else F.lit(False)
        n, taken, w = src.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("source_size") * cap)),
                              F.sum(F.when(~full, F.col("w")))).first()
        if n == capped or not w:
            break
        capped, level = n, (share * total - (taken or 0.0)) / w
    return src.withColumn("target", F.least(F.col("source_size") * cap, F.col("w") * level))


def _step(acc: Column, x: Column, seed: int) -> Column:
    """One pivot: the residual ``acc.item`` against ``x``; finished items go to ``acc.done``."""
    a, b, p, q = acc["item"]["size"], x["size"], acc["item"]["p"], x["p"]

    def settle(s: Column) -> Column:
        def whole(v: Column) -> Column:
            return (v <= _NEAR) | (v >= 1 - _NEAR)

        mine = F.struct(acc["item"]["doc_id"].alias("doc_id"), acc["item"]["r"].alias("r"), a.alias("size"), s["p"].alias("p"))
        other = F.struct(x["doc_id"].alias("doc_id"), x["r"].alias("r"), b.alias("size"), s["q"].alias("p"))
        return (F.when(whole(s["p"]) & whole(s["q"]),
                       F.struct(F.lit(False).alias("has"), acc["item"].alias("item"), F.concat(acc["done"], F.array(mine, other)).alias("done")))
                .when(whole(s["p"]), F.struct(F.lit(True).alias("has"), other.alias("item"), F.concat(acc["done"], F.array(mine)).alias("done")))
                .otherwise(F.struct(F.lit(True).alias("has"), mine.alias("item"), F.concat(acc["done"], F.array(other)).alias("done"))))

    draw = unit(acc["item"]["doc_id"], acc["item"]["r"], x["doc_id"], x["r"], seed=seed)
    room = F.struct((a * (1 - p)).alias("a_up"), (a * p).alias("a_down"), (b * (1 - q)).alias("b_up"), (b * q).alias("b_down"))

    def move(m: Column) -> Column:
        up, down = F.least(m["a_up"], m["b_down"]), F.least(m["a_down"], m["b_up"])
        rise = draw * (up + down) < down
        return (F.when(rise & (m["a_up"] <= m["b_down"]), F.struct(F.lit(1.0).alias("p"), (q - m["a_up"] / b).alias("q")))
                .when(rise, F.struct((p + m["b_down"] / a).alias("p"), F.lit(0.0).alias("q")))
                .when(m["a_down"] <= m["b_up"], F.struct(F.lit(0.0).alias("p"), (q + m["a_down"] / b).alias("q")))
                .otherwise(F.struct((p - m["b_up"] / a).alias("p"), F.lit(1.0).alias("q"))))

    paired = _let(_let(room, move), settle)
    return F.when(acc["has"], paired).otherwise(F.struct(F.lit(True).alias("has"), x.alias("item"), acc["done"].alias("done")))


def _fold(items: DataFrame, seed: int, kind: str) -> DataFrame:
    """One level: (sk, block, item) -> (sk, block, has, item, done)."""
    none = F.struct(F.lit(False).alias("has"), F.lit(None).cast(kind).alias("item"), F.array().cast(f"array<{kind}>").alias("done"))
    key = F.xxhash64(F.lit(seed), "item.doc_id", "item.r")
    got = items.groupBy("sk", "block").agg(F.array_sort(F.collect_list(F.struct((-F.col("item.size")).alias("o"), key.alias("h"), F.col("item")))).alias("x"))
    return got.select("sk", "block", F.aggregate("x", none, lambda acc, x: _step(acc, x["item"], seed)).alias("a")).select("sk", "block", "a.*")


def _settle(root: DataFrame) -> DataFrame:
    """Round the last residual of a source and flip the one settled document of its block whose
    size best makes up for the words that this adds or drops."""
    off = F.when(F.col("has"), F.col("item.size") * (F.round("item.p") - F.col("item.p"))).otherwise(0.0)
    rows = root.select("sk", "has", "item", "done", off.alias("off"))
    miss = F.transform("done", lambda d, i: F.struct(
        F.when((F.round(d["p"]) == 1.0) == (F.col("off") > 0), F.abs(d["size"] - F.abs("off"))).alias("left"), i.alias("at")))
    best = F.array_min(F.filter(miss, lambda m: m["left"] < F.abs("off")))
    rows = rows.withColumn("flip", F.coalesce(best["at"], F.lit(-1)))
    settled = F.transform("done", lambda d, i: F.struct(
        d["doc_id"], d["r"], d["size"], F.when(F.col("flip") == i, 1.0 - F.round(d["p"])).otherwise(F.round(d["p"])).alias("up")))
    last = F.struct(F.col("item.doc_id"), F.col("item.r"), F.col("item.size"), F.round("item.p").alias("up"))
    return rows.select("sk", F.explode(F.when(F.col("has"), F.concat(settled, F.array(last))).otherwise(settled)).alias("d")).select("sk", "d.*")


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
        cap: float = CAP, seed: int = 13) -> DataFrame:
    """``docs`` (doc_id, source, text) -> (doc_id, source, size, source_size, target, copies, taken)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) if size is None else size
    rows = (docs.select("doc_id", "source", size.cast("long").alias("size"))
            .groupBy("doc_id", "source", "size").agg(F.count("*").cast("int").alias("m")))
    light = written(rows.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), "m")).alias("r")), "mix-rows")
    kind = _ITEM.format(id=light.schema["doc_id"].dataType.simpleString())
    src = written(_sources(light, weights, share, cap).withColumn("sk", F.xxhash64("source", F.col("source").isNull()))
                  .withColumn("x", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "mix-targets")
    joined = light.alias("l").join(src.alias("s"), F.col("l.source").eqNullSafe(F.col("s.source")), "inner")
    frac = F.col("x") - F.floor("x")
    whole = (F.col("size") == 0) | (frac <= _NEAR) | (frac >= 1 - _NEAR)
    base = joined.select("l.doc_id", "r", "size", "sk", "n", frac.alias("p"), whole.alias("whole"))
    item = F.struct("doc_id", "r", "size", "p").cast(kind)
    level = base.where("not whole").select("sk", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "r"), F.ceil(F.col("n") / FANIN)).alias("block"), item.alias("item"))
    most = src.agg(F.max("n")).first()[0] or 0
    done = base.where("whole").select("sk", "doc_id", "r", "size", F.when(F.col("size") == 0, 0.0).otherwise(F.round("p")).alias("up"))
    blocks = math.ceil(most / FANIN)
    while most:
        folded = written(_fold(level, seed, kind), "mix-level")
        if blocks <= 1:
            done = done.union(_settle(folded))
            break
        got = folded.select("sk", F.explode("done").alias("d"))
        done = done.union(got.select("sk", "d.doc_id", "d.r", "d.size", F.round("d.p")))
        left = folded.where("has").select("sk", "block", "item")
        level, blocks = left.select("sk", F.floor(F.col("block") / FANIN).alias("block"), "item"), math.ceil(blocks / FANIN)
    copies = (F.floor("x") + F.col("up")).cast("int")
    return (done.join(src, "sk").select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                                        (F.col("size") * copies).alias("taken")))
