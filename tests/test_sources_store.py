"""Corpus scans, mixed-format datasets, concurrent registry commits and rank trees."""

import hashlib
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from lexiforge.functions.hashing import rank_tree_hash
from lexiforge.operators import registry
from lexiforge.operators.registry_store import RegistryStore
from lexiforge.sources import corpus


def test_corpus_scan(spark, tmp_path):
    want = []
    for k in range(4):
        rows = [{"text": f"{k}.{i}"} if i % 3 else {"text": i if i % 2 else None} if i % 2 else {"other": 1} for i in range(20)]
        (tmp_path / f"part-{k}.jsonl").write_text("\n".join([json.dumps(r) for r in rows] + ["", "  "]))
        want += [r["text"] for r in rows if isinstance(r.get("text"), str)]
    got = [r["text"] for r in corpus.scan_texts(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    per_file = len(want) // 4
    for limit in (0, 1, per_file, per_file + 5, 3 * per_file, 1000):
        assert sorted(r["text"] for r in corpus.scan_texts(spark, str(tmp_path), limit=limit).collect()) == sorted(want[:limit])
    plan = corpus.scan_texts(spark, str(tmp_path), limit=per_file).inputFiles()
    assert {p.rsplit("/", 1)[1] for p in plan} == {"part-0.jsonl"}
    (tmp_path / "part-9.jsonl").write_text('{"text": "open')
    with pytest.raises(Exception, match="(?i)json|malformed"):
        corpus.scan_texts(spark, str(tmp_path)).collect()
    with pytest.raises(FileNotFoundError):
        corpus.scan_texts(spark, str(tmp_path / "none"))


def test_mixed_formats(spark, tmp_path):
    rows = spark.createDataFrame([(f"{s}-{i}", "lm", f"t{i}", i, s) for s in ("train", "valid", "test") for i in range(5)],
                                 "id string, task string, text string, ord long, split string")
    stored = rows.selectExpr("id", "task", "text", "null src", "null tgt", "null label", "null meta", "ord", "split")
    stored.where("split = 'valid'").drop("split", "src", "tgt", "label", "meta").write.parquet(f"{tmp_path}/records/split=valid")
    for s in ("train", "test"):
        stored.where(F.col("split") == s).select("id", "task", "text", "ord").write.json(f"{tmp_path}/records/split={s}")
    splits = ("train", "valid", "test")
    assert corpus.split_formats(spark, str(tmp_path), splits) == {"train": "jsonl", "test": "jsonl", "valid": "parquet"}
    df = corpus.read_splits(spark, str(tmp_path), splits)
    assert {(r["split"], r["id"], r["text"], r["ord"]) for r in df.collect()} == {(r["split"], r["id"], r["text"], r["ord"]) for r in rows.collect()}
    with pytest.raises(FileNotFoundError, match="dev"):
        corpus.read_splits(spark, str(tmp_path), ("train", "dev"))


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    store = RegistryStore(spark, f"file://{tmp_path}/reg")
    assert store.version() == -1 and store.load().count() == 0
    seen, errors = [], []

    def write(k):
        try:
            for j in range(3):
                inc = spark.createDataFrame([(0, f"d/{k}-{j}", f"{k}-{j}", "h", "t"), (1, "d/shared", f"{k}", "h", "t")],
                                            "seq long, path string, name string, manifest_hash string, created_utc string")
                seen.append(RegistryStore(spark, f"file://{tmp_path}/reg").upsert(inc))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(seen) == list(range(9))
    rows = store.load().collect()
    assert {r["path"] for r in rows} == {"d/shared", *(f"d/{k}-{j}" for k in range(3) for j in range(3))}
    assert sorted(r["pos"] for r in rows) == list(range(10))
    assert store.load(0).count() == 2  # earlier versions stay readable
    assert registry.empty(spark).columns == store.load().columns


def _plain_tree(lines, fanout):
    level = [hashlib.sha256(x.encode()).hexdigest() for x in lines]
    while True:
        level = [hashlib.sha256("\n".join(level[i:i + fanout]).encode()).hexdigest() for i in range(0, len(level), fanout)]
        if len(level) == 1:
            return level[0]


@pytest.mark.parametrize("fanout", [4, 65536])
def test_rank_tree_of_sparse_ordinals(spark, fanout):
    r = random.Random(1)
    rows = [(g, r.randrange(-2**62, 2**62), f"line {i}") for g, n in (("a", 150), ("b", 1), ("c", 17)) for i in range(n)]
    want = {g: _plain_tree([x for _, _, x in sorted(y for y in rows if y[0] == g)], fanout) for g in "abc"}
    df = spark.createDataFrame(rows, "g string, o long, line string")
    for parts in (1, 7):
        got = rank_tree_hash(df.repartition(parts), ["g"], ["o"], "line", fanout=fanout)
        assert {x["g"]: x["hash"] for x in got.collect()} == want
    alone = rank_tree_hash(df.where("g = 'a'"), [], ["o"], "line", fanout=fanout).collect()
    assert [x["hash"] for x in alone] == [want["a"]]
    assert rank_tree_hash(df.limit(0), ["g"], ["o"], "line").count() == 0
