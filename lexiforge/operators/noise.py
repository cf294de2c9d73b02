"""Text corruption: drop a character, swap adjacent characters, swap adjacent words, synonym.

Every step is a column expression gated by its own keyed draw, so the operators run on
batch tables and streams alike and give the same output under any partitioning.
Step order is drop -> typo -> swap -> synonym; a probability of 0 removes the step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.draws import uniform
from lexiforge.functions.text import col_, words
from lexiforge.operators.sizes import BROADCAST_BYTES, broadcast_if_small


@dataclass(frozen=True)
class NoiseConfig:
    drop_prob: float = 0.0
    typo_prob: float = 0.0
    swap_prob: float = 0.0
    synonym_prob: float = 0.0

    def __post_init__(self):
        for k, v in self.__dict__.items():
            if not 0.0 <= v <= 1.0:
                raise ValueError(f"{k} must be within [0, 1]")


def drop_char(text, u_pos: Column) -> Column:
    """Remove the character at floor(u * length); unchanged when shorter than 2."""
    t = col_(text)
    n = F.length(t)
    i = F.floor(u_pos * n).cast("int")
    dropped = F.concat(t.substr(F.lit(1), i), t.substr(i + 2, n))
    return F.when(n < 2, t).otherwise(dropped)


def typo(text, u_pos: Column) -> Column:
    """Swap the characters at i and i+1, i = floor(u * (length - 1)); unchanged when shorter than 2."""
    t = col_(text)
    n = F.length(t)
    i = F.floor(u_pos * (n - 1)).cast("int")  # 0-based
    swapped = F.concat(t.substr(F.lit(1), i), t.substr(i + 2, F.lit(1)), t.substr(i + 1, F.lit(1)),
                       t.substr(i + 3, n))
    return F.when(n < 2, t).otherwise(swapped)


def swap_words(df: DataFrame, text_col: str, u_pos: Column, out_col: str, gate: Column | None = None) -> DataFrame:
    """Swap words i and i+1, i = floor(u * (words - 1)); the result is the words joined by
    single spaces; unchanged when there are fewer than 2 words.

    The word array and the two swapped words are staged as columns first: a lambda
    must not re-evaluate the split for every element.
    """
    staged = (df.withColumn("_sw_ws", words(F.col(text_col)))
              .withColumn("_sw_i", F.floor(u_pos * (F.size("_sw_ws") - 1)).cast("int"))
              .withColumn("_sw_a", F.get(F.col("_sw_ws"), F.col("_sw_i")))
              .withColumn("_sw_b", F.get(F.col("_sw_ws"), F.col("_sw_i") + 1)))
    swapped = F.array_join(F.transform(F.col("_sw_ws"), lambda w, j: F.when(j == F.col("_sw_i"), F.col("_sw_b"))
                                       .when(j == F.col("_sw_i") + 1, F.col("_sw_a")).otherwise(w)), " ")
    ok = F.size("_sw_ws") >= 2
    if gate is not None:
        ok = gate & ok
    return (staged.withColumn(out_col, F.when(ok, swapped).otherwise(F.col(text_col)))
            .drop("_sw_ws", "_sw_i", "_sw_a", "_sw_b"))


def synonym_frame(synonyms: DataFrame) -> DataFrame:
    """(word, synonym) pairs -> one row per word with its ordered synonym list."""
    return (synonyms.groupBy("word")
            .agg(F.array_sort(F.collect_set("synonym")).alias("_syns")))


def add_noise(df: DataFrame, text_col: str, key: list, config: NoiseConfig, out_col: str | None = None,
              synonyms: DataFrame | None = None, broadcast_limit: int = BROADCAST_BYTES) -> DataFrame:
    """Apply the noise steps (drop, typo, swap, synonym) to ``text_col``; ``key`` lists the columns/literals that make
    each row's draws unique (e.g. seed, split, index)."""
    out_col = out_col or text_col
    t = F.col(text_col)

    def u(slot):
        return uniform(*key, slot)

    if config.drop_prob > 0:
        t = F.when(u("drop") < config.drop_prob, drop_char(t, u("drop_at"))).otherwise(t)
    if config.typo_prob > 0:
        t = F.when(u("typo") < config.typo_prob, typo(t, u("typo_at"))).otherwise(t)
    df = df.withColumn(out_col, t)
    if config.swap_prob > 0:
        df = swap_words(df, out_col, u("swap_at"), out_col, gate=u("swap") < config.swap_prob)
    if config.synonym_prob > 0 and synonyms is not None:
        df = apply_synonyms(df, out_col, key, config.synonym_prob, synonyms, broadcast_limit)
    return df


def apply_synonyms(df: DataFrame, text_col: str, key: list, prob: float, synonyms: DataFrame,
                   broadcast_limit: int = BROADCAST_BYTES) -> DataFrame:
    """Replace one uniformly chosen word by one of its synonyms (uniform), if it has any.

    Texts that change are re-joined with single spaces, like the word swap.  The synonym
    table is broadcast only when it takes at most ``broadcast_limit`` bytes; otherwise it
    is a shuffle join on the chosen word.
    """
    table = broadcast_if_small(synonym_frame(synonyms), broadcast_limit)
    ws = words(F.col(text_col))
    gate = uniform(*key, "synonym") < prob
    pos = F.floor(uniform(*key, "synonym_at") * F.size(ws)).cast("int")
    staged = (df.withColumn("_ws", F.when(gate & (F.size(ws) > 0), ws))
              .withColumn("_at", pos)
              .withColumn("_w", F.get(F.col("_ws"), F.col("_at"))))
    joined = staged.join(table, staged["_w"] == table["word"], "left").drop("word")
    joined = joined.withColumn(
        "_pick", F.get(F.col("_syns"), F.floor(uniform(*key, "synonym_pick") * F.size("_syns")).cast("int")))
    replaced = F.array_join(F.transform(F.col("_ws"), lambda w, j: F.when(j == F.col("_at"), F.col("_pick"))
                                        .otherwise(w)), " ")
    return (joined.withColumn(text_col, F.when(F.col("_syns").isNotNull(), replaced).otherwise(F.col(text_col)))
            .drop("_ws", "_at", "_w", "_syns", "_pick"))
