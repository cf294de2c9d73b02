"""Weighted choice by an alias table: one equi-join row a draw, whatever the weights.

A table of n choices has n slots of equal size.  A slot holds a choice of its own and one alias, so a
draw picks a slot, uniformly, and then one of two.  No intervals are compared: there are no gaps,
no overlaps, and a choice that holds nearly all the weight is the alias of many slots, not one hot key.

The table is built from prefix sums alone.  Weights are integers, scaled so that a slot's size is
their total.  Light choices leave room in their slots, heavy ones have an excess; both are laid out along
a line in order.  A light choice takes all its missing mass from the heavy one on whose stretch its room
begins.  Where the last such room runs past the stretch's end, the heavy choice has given too much by just that
length, so its own slot takes as much from the next heavy choice.  Both lookups, the stretch at a place and
the room across an end, are counts of earlier ends, and so prefix sums over the two lists merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.operators.indexing import prefix_sum

SCALE = 1 << 32  # integer weights add up to about this much a group


def integer_weights(choices: DataFrame, weight_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """``choices`` of positive weight with ``_w``: shares of SCALE, rounded, at least 1."""
    g = list(group_cols)
    able = choices.where(F.col(weight_col) > 0)
    totals = able.groupBy(*g).agg(F.sum(F.col(weight_col).cast("double")).alias("_sum"))
    able = able.join(F.broadcast(totals), g) if g else able.withColumn("_sum", F.lit(totals.first()["_sum"]))
    share = F.col(weight_col).cast("double") / F.col("_sum") * float(SCALE)
    return able.withColumn("_w", F.greatest(F.floor(share + 0.5), F.lit(1)).cast("long")).drop("_sum")


def _before(df: DataFrame, order: Sequence[str], g: list[str], value: str | None, name: str, bounded: bool) -> DataFrame:
    """Sum of an integer column (or number of rows) over the earlier rows of the group."""
    if not bounded:
        return prefix_sum(df, order, g, value, name)
    w = Window.partitionBy(*g).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(F.col(value) if value else F.lit(1)).over(w), F.lit(0)).cast("long"))


def alias_table(choices: DataFrame, order_col: str, weight_col: str, group_cols: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """(group, slot, n, own, choice, alias): ``choice`` and ``alias`` are values of ``order_col``, unique in a group;
    ``own`` is the share of the slot that is the choice's.  Rows of no positive weight are left out.

    ``bounded``: the groups are known to be small, so plain windows do instead of distributed prefix sums.
    """
    g = list(group_cols)
    w = integer_weights(choices, weight_col, g).select(*g, F.col(order_col).alias("choice"), "_w")
    sums = w.groupBy(*g).agg(F.sum("_w").alias("_total"), F.count(F.lit(1)).alias("n"))  # one row a group
    if g:
        w = w.join(F.broadcast(sums), g)
    else:
        one = sums.first()
        w = w.withColumns({"_total": F.lit(one["_total"]).cast("long"), "n": F.lit(one["n"]).cast("long")})
    w = _before(w, ["choice"], g, None, "slot", bounded)
    room = F.col("_total") - F.col("_w") * F.col("n")  # of a slot: negative is excess
    w = w.withColumn("_heavy", (room < 0).cast("int")).withColumn("_size", F.abs(room).cast("long"))
    w = _before(w, ["choice"], [*g, "_heavy"], "_size", "_start", bounded)
    w = _before(w, ["choice"], [*g, "_heavy"], None, "_nth", bounded)
    w = w.withColumn("_end", (F.col("_start") + F.col("_size")).cast("long"))
    # light rows ask at their start, heavy ones at their end; ends are counted.  At one place a stretch's end
    # comes before a question (the next stretch holds it), and a question before a room's end (the room reaches it)
    key = [F.col(c) for c in g]
    marks = (w.select(*key, F.col("_end").alias("_at"), F.when(F.col("_heavy") == 1, 0).otherwise(3).alias("_turn"), "_heavy", "choice", F.lit(1).alias("_one"))
             .unionByName(w.select(*key, F.when(F.col("_heavy") == 1, F.col("_end")).otherwise(F.col("_start")).alias("_at"),
                                   F.when(F.col("_heavy") == 1, 2).otherwise(1).alias("_turn"), "_heavy", "choice", F.lit(0).alias("_one"))))
    marks = marks.withColumn("_h", (F.col("_one") * F.col("_heavy")).cast("long")).withColumn("_l", (F.col("_one") * (1 - F.col("_heavy"))).cast("long"))
    order = ["_at", "_turn", "choice"]
    marks = _before(marks, order, g, "_h", "_stretches", bounded)
    marks = _before(marks, order, g, "_l", "_rooms", bounded)
    asked = marks.where("_one = 0").select(*g, "choice", "_stretches", "_rooms")
    w = w.join(asked, [*g, "choice"])
    heavy = w.where("_heavy = 1").select(*g, F.col("_nth").alias("_stretches"), F.col("choice").alias("_giver"))
    light = w.where("_heavy = 0").join(heavy, [*g, "_stretches"], "left").select(
        *g, "slot", "n", (F.col("_w") * F.col("n") / F.col("_total")).alias("own"), "choice", F.coalesce("_giver", "choice").alias("alias"))
    rooms = w.where("_heavy = 0").select(*g, F.col("_nth").alias("_rooms"), F.col("_end").alias("_reach"))
    following = heavy.select(*g, (F.col("_stretches") - 1).alias("_nth"), F.col("_giver").alias("_next"))
    over = F.when(F.col("_next").isNull(), 0).otherwise(F.coalesce(F.col("_reach") - F.col("_end"), F.lit(0)))
    heavies = (w.where("_heavy = 1").join(rooms, [*g, "_rooms"], "left").join(following, [*g, "_nth"], "left").select(
        *g, "slot", "n", ((F.col("_total") - over) / F.col("_total")).alias("own"), "choice", F.coalesce("_next", "choice").alias("alias")))
    return light.unionByName(heavies)


def alias_choice(samples: DataFrame, u_col: str, table: DataFrame, group_cols: Sequence[str] = (), name: str = "choice") -> DataFrame:
    """``samples`` with the chosen value for the uniform draw ``u_col``; null where the draw is null or the group has no choices."""
    g = list(group_cols)
    sizes = table.select(*g, "n").distinct()  # one row a group
    slots = table.select(*[F.col(c).alias(f"_g_{c}") for c in g], F.col("slot").alias("_slot"), "own", "choice", "alias")
    if g:
        s = samples.join(F.broadcast(sizes.withColumnRenamed("n", "_n")), g, "left")
    else:
        size = sizes.first()
        s = samples.withColumn("_n", F.lit(size["n"] if size else None).cast("long"))
    x = F.col(u_col) * F.col("_n")
    s = s.withColumn("_at", F.floor(x).cast("long")).withColumn("_part", x - F.floor(x))
    out = s.join(slots, [s["_at"] == slots["_slot"], *[s[c] == slots[f"_g_{c}"] for c in g]], "left")
    return out.select(*[s[c] for c in samples.columns], F.when(F.col("_part") < F.col("own"), F.col("choice")).otherwise(F.col("alias")).alias(name))
