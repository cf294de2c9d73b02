"""What was made from what: a table of edges that carry the hash of each input at the time of making."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.session import cut_lineage

EDGES = "artifact string, made_from string, input_hash string"  # made_from null: made from nothing that is tracked
HASHES = "artifact string, hash string"


def check(edges: DataFrame, recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(artifact, status) of every artifact of ``edges``.

    ``changed``: its current hash is not the recorded one; ``missing``: it has no current hash; ``stale``: it is as
    recorded, but an input is not what it was made from, or is itself changed, stale or missing; else ``ok``.
    Staleness is passed on along the edges, one join a level, until nothing is added; cycles end as well.
    """
    known = edges.select("artifact").union(edges.where("made_from is not null").select("made_from")).distinct()
    state = (known.join(recorded.withColumnRenamed("hash", "was"), "artifact", "left").join(current.withColumnRenamed("hash", "now"), "artifact", "left")
             .select("artifact", "now", F.when(F.col("now").isNull(), "missing").when(F.col("was") != F.col("now"), "changed").otherwise("ok").alias("status")))
    inputs = edges.where("made_from is not null")
    off = (inputs.join(state.select(F.col("artifact").alias("made_from"), "now", "status"), "made_from")
           .where((F.col("status") != "ok") | (F.col("now") != F.col("input_hash"))).select("artifact").distinct())
    off, before = cut_lineage(off), -1
    while (size := off.count()) != before:
        before = size
        further = inputs.join(off.withColumnRenamed("artifact", "made_from"), "made_from", "left_semi").select("artifact")
        off = cut_lineage(off.union(further).distinct())
    return state.join(off.withColumn("_off", F.lit(True)), "artifact", "left").select(
        "artifact", F.when((F.col("status") == "ok") & F.col("_off").isNotNull(), "stale").otherwise(F.col("status")).alias("status"))
