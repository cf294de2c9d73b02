"""Corpus limit, normalisation, registry store versions, manifest structure rules."""

import unicodedata

from pyspark.sql import functions as F

from lexiforge.operators import bpe
from lexiforge.operators import dataset as ds
from lexiforge.operators import registry as reg


def test_training_corpus_limit_counts_accepted_rows_only(spark):
    df = spark.createDataFrame([(0, None), (1, "a"), (2, None), (3, "b"), (4, "c")], "k int, text string")
    got = [r["text"] for r in bpe.training_corpus(df, "text", "k", limit=2).collect()]
    assert got == ["a", "b"]


def test_normalize_then_lower(spark):
    s = "ＡＢＣ é"  # full-width letters, decomposed e-acute
    df = spark.createDataFrame([(s,)], "t string")
    got = df.select(bpe.preprocess(F.col("t"), lowercase=True, normalize="NFKC").alias("x")).first()["x"]
    assert got == unicodedata.normalize("NFKC", s).lower()


def test_registry_store_versions(spark, tmp_path):
    base = str(tmp_path / "registry")
    assert reg.load(spark, base).count() == 0
    inc = spark.createDataFrame([(1, "d/a", "a", "h1", "t1")],
                                "seq long, path string, name string, manifest_hash string, created_utc string")
    v0 = reg.save(reg.upsert(reg.load(spark, base), inc), base)
    inc2 = spark.createDataFrame([(1, "d/b", "b", "h2", "t2"), (2, "d/a", "a", "h3", "t3")],
                                 "seq long, path string, name string, manifest_hash string, created_utc string")
    v1 = reg.save(reg.upsert(reg.load(spark, base), inc2), base)
    assert (v0, v1) == (0, 1)
    rows = {r["path"]: r for r in reg.load(spark, base).collect()}
    assert rows["d/a"]["manifest_hash"] == "h3" and rows["d/a"]["pos"] == 0
    assert rows["d/b"]["pos"] == 1


def test_manifest_violations(spark):
    m = spark.createDataFrame([("{}", "h", ""), ("not json", None, "t"), (None, "h", None)],
                              "split_hashes string, dataset_hash string, tokenizer_hash string")
    v = {r["rule"]: r["violations"] for r in ds.manifest_violations(m).collect()}
    assert v == {"split_hashes_missing": 1, "split_hashes_not_mapping": 1, "no_splits_declared": 1,
                 "dataset_hash_missing": 1, "tokenizer_hash_empty": 1}


def test_lexicon_positions_distributed_equals_bounded(spark, small_sf):
    from lexiforge.operators import lexicon as lex

    v = lex.domain_vocabulary(spark.read.parquet(f"{small_sf}/documents.parquet"), "source", "text", 30)
    e = lex.normalise_entries(v.select("domain", F.col("word").alias("value"), "rank"))
    a = lex.shuffle_positions(e, "domain", "rank", 3, bounded=True).select("domain", "pos", "token")
    b = lex.shuffle_positions(e, "domain", "rank", 3, bounded=False).select("domain", "pos", "token")
    assert sorted(a.collect()) == sorted(b.collect())
    t = lex.lexicon_summary(lex.shuffle_positions(e, "domain", "rank", 3), "domain", ["token"], mode="tree")
    assert t.count() == e.select("domain").distinct().count()
