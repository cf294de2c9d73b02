"""Streaming versions: the same column operators on ``readStream`` input.

Runs use the ``availableNow`` trigger (process what is there, then stop), write to a
table under the shared checkpoint folder, and return that table.  Output of a
complete-mode aggregate is rewritten per micro-batch through ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.text import chars
from lexiforge.session import scratch_path


def source(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream the Parquet files of ``path``: a directory, or one file given as a glob
    (the file source watches a directory or a glob pattern, not a single file)."""
    schema = spark.read.parquet(path).schema
    glob = path if path.endswith("/") or "*" in path or "[" in path else path[:-1] + "[" + path[-1] + "]"
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(glob)


def streaming_stats(stream: DataFrame, split_col: str, text_col: str) -> DataFrame:
    """Corpus statistics as a streaming aggregate (distinct characters through a
    ``collect_set`` bounded by the alphabet, since distinct aggregates are not
    supported on streams)."""
    rows = stream.select(F.col(split_col).alias("split"), F.length(text_col).alias("_len"),
                         F.array_distinct(chars(F.col(text_col))).alias("_cs"))
    ex = rows.select("split", "_len", F.posexplode_outer("_cs").alias("_p", "_c"))
    length = F.when(F.coalesce(F.col("_p"), F.lit(0)) == 0, F.col("_len"))
    return ex.groupBy("split").agg(
        F.count(length).cast("double").alias("num_records"),
        F.avg(length).alias("avg_len"),
        F.percentile(length, F.lit(0.5)).alias("p50_len"),
        F.percentile(length, F.lit(0.95)).alias("p95_len"),
        F.size(F.collect_set("_c")).cast("double").alias("vocab_size_char"),
    )


def run_complete(agg: DataFrame, name: str) -> DataFrame:
    spark = agg.sparkSession
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")

    def sink(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = (agg.writeStream.outputMode("complete").foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def run_append(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")
    q = (df.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def stream_stats(spark: SparkSession, path: str, split_col: str, text_col: str) -> DataFrame:
    return run_complete(streaming_stats(source(spark, path), split_col, text_col), "stream-stats")


def stream_char_tokens(spark: SparkSession, path: str, key_cols: list[str], text_col: str,
                       lowercase: bool = True) -> DataFrame:
    s = source(spark, path)
    toks = chars(F.col(text_col), lowercase)
    out = s.select(*key_cols, F.size(toks).alias("n_tokens"), F.md5(F.array_join(toks, " ")).alias("tokens_md5"))
    return run_append(out, "stream-tokens")


def run_with_restart(df: DataFrame, name: str, stop_after: int, counters: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """Append ``df`` to a table, stopped after ``stop_after`` micro-batches and started again from its checkpoint.

    The sink commits whole batches, and a batch that was stopped is planned again from the checkpoint's
    offsets, so no row is lost or written twice.  ``counters`` (name -> aggregate) are observed by every
    batch; a batch that ran twice counts once.  Returns the table and the counters' sums.
    """
    spark = df.sparkSession
    out, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    observed = df.observe(name, *[c.alias(k) for k, c in counters.items()])

    def start(**trigger):
        return (observed.writeStream.outputMode("append").format("parquet").option("path", out)
                .option("checkpointLocation", ckpt).trigger(**trigger).start())

    by_batch: dict[int, dict] = {}

    def note(q) -> None:
        for p in q.recentProgress:
            got = (p.get("observedMetrics") or {}).get(name)
            if got and p["numInputRows"]:
                by_batch[p["batchId"]] = got if isinstance(got, dict) else got.asDict()

    first = start(processingTime="0 seconds")
    while first.isActive and len({p["batchId"] for p in first.recentProgress if p["numInputRows"]}) < stop_after:
        first.awaitTermination(0.05)
    first.stop()
    note(first)
    again = start(availableNow=True)
    again.awaitTermination()
    note(again)
    return spark.read.parquet(out), {k: sum(int(m[k] or 0) for m in by_batch.values()) for k in counters}
