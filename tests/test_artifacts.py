"""Stored artifacts verify by content; provenance finds what a change makes stale."""

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import provenance
from lexiforge.sources import artifacts


def test_round_trip_and_tampering(spark, tmp_path):
    df = spark.createDataFrame([(f"t{i}", i) for i in range(300)], "token string, id int")
    out = str(tmp_path / "vocab")
    first = artifacts.save(df.repartition(7), out, "tokenizer", ["id"], name="x").first()
    again = artifacts.save(df.repartition(2), str(tmp_path / "again"), "tokenizer", ["id"]).first()
    assert first["content_hash"] == again["content_hash"] and first["rows"] == 300 and first["name"] == "x"
    assert sorted(artifacts.load(spark, out).collect()) == sorted(df.collect())
    df.withColumn("token", F.when(F.col("id") == 5, "other").otherwise(F.col("token"))).write.mode("overwrite").parquet(f"{out}/data")
    assert not artifacts.verify(spark, out).first()["verified"]
    with pytest.raises(ValueError, match="does not match"):
        artifacts.load(spark, out)
    df.drop("id").write.mode("overwrite").parquet(f"{out}/data")
    assert not artifacts.verify(spark, out).first()["verified"]
    with pytest.raises(FileNotFoundError):
        artifacts.load(spark, str(tmp_path / "none"))
    empty = artifacts.save(df.limit(0), str(tmp_path / "empty"), "tokenizer", ["id"]).first()
    assert empty["rows"] == 0 and artifacts.verify(spark, str(tmp_path / "empty")).first()["verified"]


def test_provenance(spark):
    edges = spark.createDataFrame([("docs", None, None), ("tok", "docs", "d1"), ("enc", "tok", "t1"), ("enc", "conv", "c1"), ("manifest", "enc", "e1"),
                                   ("stats", "docs", "d0"), ("a", "b", "x"), ("b", "a", "y")], provenance.EDGES)
    was = {"docs": "d1", "conv": "c1", "tok": "t1", "enc": "e1", "manifest": "m1", "stats": "s1", "a": "y", "b": "x"}

    def status(now):
        hashes = [spark.createDataFrame(list(h.items()), provenance.HASHES) for h in (was, now)]
        return {r["artifact"]: r["status"] for r in provenance.check(edges, *hashes).collect()}

    same = dict.fromkeys(was, "ok")
    assert status(was) == {**same, "stats": "stale"}  # made from other documents
    assert status({**was, "tok": "t2"}) == {**same, "stats": "stale", "tok": "changed", "enc": "stale", "manifest": "stale"}
    gone = {k: v for k, v in was.items() if k != "conv"}
    assert status(gone) == {**same, "stats": "stale", "conv": "missing", "enc": "stale", "manifest": "stale"}
    assert status({**was, "a": "z"})["b"] == "stale"
