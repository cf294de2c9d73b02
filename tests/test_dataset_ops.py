"""Generation, validation, registry, lexicon and embedding properties."""

from pyspark.sql import functions as F

from lexiforge.operators import dataset as ds
from lexiforge.operators import generate as gen
from lexiforge.operators import registry as reg
from lexiforge.operators.indexing import dense_index
from lexiforge.operators.noise import NoiseConfig


def one_value_grammar(spark, weighted=False):
    t = spark.createDataFrame([(0, "{person} found a {item} at the {location}.", 1.0 if weighted else None)],
                              "template_index int, template string, weight double")
    e = spark.createDataFrame([("person", "Ann"), ("item", "book"), ("location", "library")], "entity string, value string")
    return gen.Grammar(t, e, ("person", "item", "location"))


def test_generate_one_value_grammar(spark):
    recs = gen.generate(spark, one_value_grammar(spark), [("train", 2), ("valid", 1), ("test", 1)], 13).collect()
    assert len(recs) == 4 * 3
    by = {r["id"]: r for r in recs}
    assert by["train-lm-000000"]["text"] == "Ann found a book at the library."
    assert by["train-seq2seq-000001"]["tgt"] == "book -> library"
    assert by["test-cls-000000"]["label"] == "found"
    assert by["valid-seq2seq-000000"]["src"] == "Ann found a book at the library."
    assert by["train-lm-000000"]["src"] is None


def test_record_id_widens(spark):
    df = spark.createDataFrame([("train", "lm", 42), ("train", "lm", 1234567)], "split string, task string, i long")
    ids = [r[0] for r in df.select(F.format_string("%s-%s-%06d", "split", "task", "i")).collect()]
    assert ids == ["train-lm-000042", "train-lm-1234567"]


def test_same_seed_same_hash_and_seed_matters(spark, small_sf):
    from lexiforge.plans.queries import table_grammar, table_splits

    g = table_grammar(spark, small_sf)
    splits = table_splits(spark, small_sf)

    def dhash(seed):
        recs = ds.with_canonical_line(gen.generate(spark, g, splits, seed, noise=NoiseConfig(0.3, 0.3, 0.3)),
                                      ds.RECORD_COLUMNS)
        return ds.dataset_hash(ds.split_hashes(recs, "ord")).first()[0]

    assert dhash(13) == dhash(13)
    assert dhash(13) != dhash(14)


def test_weighted_template_mix(spark):
    t = spark.createDataFrame([(0, "a{x}", 2.0), (1, "b{x}", 3.0), (2, "c{x}", 0.0)],
                              "template_index int, template string, weight double")
    e = spark.createDataFrame([("x", "1")], "entity string, value string")
    g = gen.Grammar(t, e, ("x",))
    s = gen.choose_templates(gen.sample_space(spark, [("train", 20000)]), g, 1)
    counts = {r["template_index"]: r["count"] for r in s.groupBy("template_index").count().collect()}
    assert 2 not in counts
    assert abs(counts[0] / 20000 - 0.4) < 0.02


def test_grammar_violations(spark):
    t = spark.createDataFrame([(0, "{person} met {ghost}", -1.0), (1, "x", None)],
                              "template_index int, template string, weight double")
    e = spark.createDataFrame([("person", "Ann")], "entity string, value string")
    v = {r["rule"]: r["violations"] for r in gen.grammar_violations(gen.Grammar(t, e, ("person", "item"))).collect()}
    assert v["empty_entity"] == 1 and v["unknown_placeholder"] == 1
    assert v["negative_weight"] == 1 and v["weights_count"] == 1 and v["weights_total"] == 1


def test_dense_index(spark):
    df = spark.createDataFrame([(g, v) for g in ("a", "b") for v in range(50)], "g string, v int").repartition(5)
    out = dense_index(df, ["v"], ["g"], "pos").collect()
    assert all(r["pos"] == r["v"] for r in out)


def test_validate_detects_tampering(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select("doc_id", F.col("lang").alias("split"), F.to_json(F.struct("text")).alias("line"))
    declared = ds.split_hashes(lines, "doc_id")
    changed = lines.withColumn("line", F.when(F.col("doc_id") == 3, F.lit("{}")).otherwise(F.col("line")))
    res = {r["split"]: r["status"] for r in ds.validate_hashes(declared, ds.split_hashes(changed, "doc_id"), None).collect()}
    lang3 = docs.where("doc_id = 3").first()["lang"]
    assert res[lang3] == "mismatch" and res["__dataset__"] == "mismatch"
    assert sum(1 for s in res.values() if s == "ok") == len(res) - 2


def test_jsonl_and_parquet_hash_equal(spark, tmp_path):
    from lexiforge.sources import io

    recs = gen.generate(spark, one_value_grammar(spark), [("train", 5), ("valid", 2), ("test", 2)], 3)
    hashes = {}
    for fmt in io.FORMATS:
        io.write_records(recs, str(tmp_path / fmt), fmt)
        back = io.read_records(spark, str(tmp_path / fmt), fmt, splits=("train", "valid", "test"))
        lines = ds.with_canonical_line(back, ds.RECORD_COLUMNS)
        hashes[fmt] = sorted(ds.split_hashes(lines, "ord").collect())
    assert hashes["jsonl"] == hashes["parquet"]


def test_registry_upsert_idempotent(spark):
    existing = reg.empty(spark)
    inc = spark.createDataFrame([(1, "d/a", "a", "h1", "t1"), (2, "d/a", "a", "h2", "t2")],
                                "seq long, path string, name string, manifest_hash string, created_utc string")
    once = reg.upsert(existing, inc)
    twice = reg.upsert(once, inc)
    rows = twice.collect()
    assert len(rows) == 1 and rows[0]["manifest_hash"] == "h2" and rows[0]["pos"] == 0
    assert sorted(once.collect()) == sorted(rows)


def test_registry_name_from_path(spark):
    df = spark.createDataFrame([(None, "a/b/c/"), ("n", "a/b")], "m string, p string")
    assert [r[0] for r in df.select(reg.entry_name(F.col("m"), F.col("p"))).collect()] == ["c", "n"]


def test_embeddings_order_independent(spark):
    from lexiforge.operators import embed

    toks = spark.createDataFrame([(t,) for t in embed.DEFAULT_CHAR_TOKENS], "token string")
    a = embed.fixed_embeddings(toks, 8, 1).collect()
    b = embed.fixed_embeddings(toks.orderBy(F.desc("token")).repartition(3), 8, 1).collect()
    assert sorted(a) == sorted(b)
    assert all(-1.0 <= v < 1.0 and len(r["values"]) == 8 for r in a for v in r["values"])


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_extra_meta_changes_hash(spark):
    g = one_value_grammar(spark)
    plain = gen.generate(spark, g, [("train", 3)], 1)
    tagged = gen.generate(spark, g, [("train", 3)], 1, extra_meta={"tokenizer_hash": "abc"})
    assert tagged.select("meta.tokenizer_hash").first()[0] == "abc"
    h = [ds.split_hashes(ds.with_canonical_line(d, ds.RECORD_COLUMNS), "ord").first()["split_hash"] for d in (plain, tagged)]
    assert h[0] != h[1]
    line = ds.with_canonical_line(tagged, ds.RECORD_COLUMNS).first()["line"]
    assert '"meta":{"grammar_rev":' in line and '"tokenizer_hash":"abc"}' in line


def test_write_validate_and_tamper(spark, tmp_path):
    from lexiforge.sources import io

    recs = gen.generate(spark, one_value_grammar(spark), [("train", 6), ("valid", 2), ("test", 2)], 3,
                        noise=NoiseConfig(0.5, 0.5, 0.5))
    out = str(tmp_path / "ds")
    man = io.write_dataset(recs, out, "jsonl", "toy", {"tokenizer_hash": "t"})
    assert {r["split"]: r["row_count"] for r in man.collect()} == {"train": 18, "valid": 6, "test": 6}
    assert {r["status"] for r in io.validate_dataset(spark, out).collect()} == {"ok"}
    # rewrite the valid split with one record changed
    back = io.read_records(spark, out, "jsonl")
    changed = back.withColumn("text", F.when(F.col("id") == "valid-lm-000000", F.lit("x")).otherwise(F.col("text")))
    io.write_records(changed.cache(), str(tmp_path / "ds2"), "jsonl")
    man.write.mode("overwrite").parquet(str(tmp_path / "ds2" / "manifest"))
    res = {r["split"]: r["status"] for r in io.validate_dataset(spark, str(tmp_path / "ds2")).collect()}
    assert res == {"train": "ok", "valid": "mismatch", "test": "ok", "__dataset__": "mismatch"}
    assert io.validate_dataset(spark, str(tmp_path / "nothing")).first()["status"] == "missing"


def test_weighted_entity_values(spark):
    t = spark.createDataFrame([(0, "{x}", None)], "template_index int, template string, weight double")
    e = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 3.0), ("x", "c", 0.0)],
                              "entity string, value string, weight double")
    recs = gen.generate(spark, gen.Grammar(t, e, ("x",)), [("train", 8000)], 5, tasks=("lm",))
    counts = {r["text"]: r["count"] for r in recs.groupBy("text").count().collect()}
    assert "c" not in counts
    assert abs(counts["b"] / 8000 - 0.75) < 0.03


def test_dense_index_neither_windows_nor_shuffles_its_rows(spark):
    """Rows are numbered before the cut: what follows is a join with a small table."""
    df = spark.range(1000).selectExpr("id % 3 as g", "id * 7 % 1000 as v")
    out = dense_index(df, ["v"], ["g"], "pos")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastHashJoin" in plan
    got = {}
    for r in out.orderBy("g", "v").collect():
        assert r["pos"] == got.setdefault(r["g"], 0)
        got[r["g"]] += 1
    assert sum(got.values()) == 1000
    nulls = spark.createDataFrame([(None, 1), ("a", 2), ("a", None)], "g string, v int")
    assert {(r["g"], r["v"], r["pos"]) for r in dense_index(nulls, ["v"], ["g"], "pos").collect()} == {("a", None, 0), ("a", 2, 1)}
