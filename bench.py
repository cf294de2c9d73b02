"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

Every query is executed in full (written to the ``noop`` sink, nothing is collected).
"""

from __future__ import annotations

import json
import os
import signal
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "length_stats_by_lang", "char_vocab", "byte_tokenize", "noise_all_steps", "split_hash",
    "generated_manifest", "generate_cls", "domain_lexicon", "lexicon_summary",
    "mean_embeddings", "validate_hashes", "stream_stats", "weighted_entities", "wordpiece_train", "bpe_train", "bpe_encode",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("lexiforge-bench")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(max(8, cpus * 2)))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexiforge-bench-ckpt-"))
    from lexiforge.plans.queries import REGISTRY
    from lexiforge.sources.tables import table

    names = sys.argv[1:] or HEADLINE
    table(spark, sf_dir, "region").count()  # JVM and Parquet-reader warm-up on the smallest table, not timed
    records = {"generate_cls": table(spark, sf_dir, "part").count(), "bpe_encode": table(spark, sf_dir, "conversations").count()}
    times: dict[str, float] = {}

    def report(unfinished: list[str]) -> None:
        sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
        rates = {f"{k}_records_per_min": round(records[q] / times[q] * 60.0, 1)
                 for k, q in (("generate", "generate_cls"), ("tokenizer_apply", "bpe_encode")) if q in times}
        print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                          "sf": sf, "cpus": cpus, **rates, **({"unfinished": unfinished} if unfinished else {})}), flush=True)

    def stopped(*_) -> None:  # one slow query does not lose the others' times
        report([n for n in names if n not in times])
        os._exit(1)

    signal.signal(signal.SIGTERM, stopped)
    for name in names:
        t0 = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr, flush=True)
    report([])
    spark.stop()


if __name__ == "__main__":
    main()
