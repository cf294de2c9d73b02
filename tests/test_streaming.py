"""Batch result equals the availableNow streaming result; schema rules detect bad records."""

from pyspark.sql import functions as F

from lexiforge.operators import dataset as ds
from lexiforge.plans.queries import REGISTRY


def test_stream_stats_equals_batch(spark, small_sf):
    batch = sorted(REGISTRY["length_stats_by_lang"](spark, small_sf).collect())
    stream = sorted(REGISTRY["stream_stats"](spark, small_sf).select(*[c for c in batch[0].asDict()]).collect())
    assert batch == stream


def test_stream_tokenize_equals_batch(spark, small_sf):
    batch = sorted(REGISTRY["char_tokenize"](spark, small_sf).collect())
    stream = sorted(REGISTRY["stream_tokenize"](spark, small_sf).select("conv_id", "turn", "n_tokens", "tokens_md5").collect())
    assert batch == stream


def test_schema_violations_detected(spark):
    rows = [("train-lm-000000", "lm", "train", 0, "t", "s", None, None, ("g", 1, "train", 0)),
            ("bad", "cls", "train", 1, "t", None, None, None, ("g", 1, "valid", 0))]
    df = spark.createDataFrame(rows, "id string, task string, split string, sample_index long, text string, src string, "
                                     "tgt string, label string, meta struct<grammar_rev:string,seed:long,split:string,template_index:int>")
    v = {r["rule"]: r["violations"] for r in ds.schema_violations(df).collect()}
    assert v["lm_forbidden_src"] == 1
    assert v["cls_missing_label"] == 1
    assert v["id_format"] == 1 and v["meta_split"] == 1
    assert v["unknown_task"] == 0


def test_queries_invariant_under_shuffle_partitions(spark, small_sf):
    names = ["length_stats_by_lang", "split_hash", "domain_lexicon", "lexicon_summary", "bpe_pair_stats"]
    before = {n: sorted(REGISTRY[n](spark, small_sf).collect()) for n in names}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        after = {n: sorted(REGISTRY[n](spark, small_sf).collect()) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert before == after
