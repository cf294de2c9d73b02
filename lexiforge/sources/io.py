"""Dataset, tokenizer-model and table sinks/sources with explicit schemas.

Layout of a written dataset directory ``out``:
  out/records/split=<name>/part-*.{json,parquet}   records, range-sorted by (split, ord)
  out/manifest/                                    one row per split + the dataset hash
JSON Lines rows hold the record's fields and its ordinal; hashes are taken over canonical lines
that are made from the fields, so they are the same for either format.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("jsonl", "parquet")

META = T.StructType([
    T.StructField("grammar_rev", T.StringType()), T.StructField("seed", T.LongType()),
    T.StructField("split", T.StringType()), T.StructField("template_index", T.IntegerType()),
])
RECORD_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("task", T.StringType(), False),
    T.StructField("text", T.StringType()), T.StructField("src", T.StringType()), T.StructField("tgt", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("meta", META),
])
STORED_SCHEMA = T.StructType(RECORD_SCHEMA.fields + [T.StructField("ord", T.LongType(), False)])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per line, schema enforced, malformed lines fail the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def write_records(records: DataFrame, out: str, fmt: str = "jsonl", mode: str = "overwrite") -> None:
    """Write a generated dataset partitioned by split, records in (split, ord) order."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt}")
    cols = [f.name for f in STORED_SCHEMA.fields]
    ordered = records.select(*cols, "split").repartitionByRange("split", "ord").sortWithinPartitions("split", "ord")
    w = ordered.write.mode(mode).partitionBy("split")
    if fmt == "parquet":
        w.parquet(f"{out}/records")
    else:
        w.json(f"{out}/records", ignoreNullFields=True)


def read_records(spark: SparkSession, out: str, fmt: str = "jsonl", splits: Sequence[str] | None = None) -> DataFrame:
    """Read a dataset written by ``write_records``; with ``splits``, a listed split that
    has no files raises ``FileNotFoundError`` (checked from the file listing, no job)."""
    schema = T.StructType(STORED_SCHEMA.fields + [T.StructField("split", T.StringType())])
    df = (read_parquet(spark, f"{out}/records", schema) if fmt == "parquet"
          else read_jsonl(spark, f"{out}/records", schema))
    if splits:
        files = df.inputFiles()
        for s in splits:
            if not any(f"/split={s}/" in f for f in files):
                raise FileNotFoundError(f"Missing split files for {s}")
    return df


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def save_tokenizer(spark: SparkSession, model, out: str) -> None:
    """BPE model as three tables: merges(rank, left, right, merged), vocab(token, id), meta."""
    model.merges_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{out}/merges")
    model.vocab_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{out}/vocab")
    spark.createDataFrame([(model.name, model.lowercase, model.normalize, model.unit)],
                          "name string, lowercase boolean, normalize string, unit string"
                          ).write.mode("overwrite").parquet(f"{out}/meta")


def load_tokenizer(spark: SparkSession, path: str):
    """Load a model saved by ``save_tokenizer``; all three tables must exist.  The model
    is bounded by its vocabulary size, so it is held by the driver and broadcast."""
    from lexiforge.operators.bpe import BpeModel

    merges = [(r["left"], r["right"]) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
    vocab = [r["token"] for r in spark.read.parquet(f"{path}/vocab").orderBy("id").collect()]
    meta = spark.read.parquet(f"{path}/meta").first()
    return BpeModel(merges, vocab, meta["lowercase"], meta["normalize"], meta["name"], meta["unit"])


def write_dataset(records: DataFrame, out: str, fmt: str = "jsonl", dataset_name: str = "dataset",
                  extra: dict[str, str] | None = None) -> DataFrame:
    """Write records (partitioned by split) and the manifest table, and return the manifest.

    The manifest has one row per split -- row count, split hash (tree mode), the five
    statistics -- and, on every row, the dataset hash over train, valid, test and the
    dataset-level fields (name, format, hash mode, caller-supplied extras such as a
    tokenizer hash or config hash).  The timestamp is recorded but never hashed.
    """
    from lexiforge.operators import dataset as ds
    from lexiforge.operators.stats import SPLITS, corpus_stats

    write_records(records, out, fmt)
    recs = ds.with_canonical_line(read_records(records.sparkSession, out, fmt), ds.RECORD_COLUMNS)  # what is on disk is described
    hashes = ds.split_hashes(recs, "ord").withColumnRenamed("num_records", "row_count")
    manifest = ds.with_dataset_hash(hashes.join(corpus_stats(recs, splits=_all_splits(recs, SPLITS)), "split", "full"))
    fields = {"dataset_name": dataset_name, "format": fmt, "hash_mode": "tree", **(extra or {})}
    for k, v in sorted(fields.items()):
        manifest = manifest.withColumn(k, F.lit(v).cast("string"))
    manifest = manifest.withColumn("timestamp_utc", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest")
    return spark_read_manifest(records.sparkSession, out)


def _all_splits(records: DataFrame, declared: Sequence[str]) -> list[str]:
    """The declared splits and any other that the records hold (split names are few)."""
    found = [r["split"] for r in records.select("split").distinct().orderBy("split").collect()]
    return [*declared, *(s for s in found if s not in declared)]


def spark_read_manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/manifest")


def validate_dataset(spark: SparkSession, out: str) -> DataFrame:
    """Recompute the split hashes of a written dataset from its files and compare them
    with the manifest: one row per split and a ``__dataset__`` row (statuses ok, mismatch,
    missing, undeclared); a missing manifest is reported as one ``manifest`` row."""
    from lexiforge.operators import dataset as ds

    try:
        manifest = spark_read_manifest(spark, out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([("manifest", "missing", None, None)],
                                     "split string, status string, declared_hash string, computed_hash string")
    fmt = manifest.select("format").first()["format"]
    recs = ds.with_canonical_line(read_records(spark, out, fmt), ds.RECORD_COLUMNS)
    return ds.validate_hashes(manifest.select("split", "split_hash"), ds.split_hashes(recs, "ord"))
