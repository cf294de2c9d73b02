"""Training texts from JSON Lines files, and datasets whose splits have different formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.sources.io import STORED_SCHEMA, read_jsonl, read_parquet


def files_below(spark: SparkSession, path: str) -> list[str]:
    """Sorted data files below a path (a listing, no job); none if the path does not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    found, walk = [], fs.listFiles(place, True)
    while walk.hasNext():
        f = walk.next().getPath()
        if not f.getName().startswith(("_", ".")):
            found.append(f.toString())
    return sorted(found)


def _accepted(spark: SparkSession, files: Sequence[str], field: str) -> DataFrame:
    """(file, block, row, text) of every line whose ``field`` is a string; a malformed line raises.

    ``block`` and ``row`` order the lines of one file, however it is split.
    """
    lines = spark.read.text(list(files)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))
    parsed = lines.where(F.trim("value") != "").withColumn("_v", F.parse_json("value"))
    inner = F.try_variant_get("_v", f"$.{field}", "variant")
    return parsed.where(F.schema_of_variant(inner) == "STRING").select(
        "file", "block", "row", F.variant_get(inner, "$", "string").alias("text"))


def scan_texts(spark: SparkSession, path: str, field: str = "text", limit: int | None = None) -> DataFrame:
    """(text) of the JSON Lines files below ``path``, in order of file name and line.

    Each line is one JSON value; a malformed one fails the job.  Only rows whose ``field`` is a string
    are accepted and count against ``limit``.  With a limit, accepted rows are counted file by file; files
    that lie within it are read whole, the one that crosses it is cut, later ones are not read.
    """
    files = files_below(spark, path)
    if not files:
        raise FileNotFoundError(f"Training input not found: {path}")
    if limit is None:
        return _accepted(spark, files, field).select("text")
    counts = {r["file"]: r["count"] for r in _accepted(spark, files, field).groupBy("file").count().collect()}  # one row a file
    whole, cut, left = [], None, limit
    for f in sorted(counts):
        if left <= 0:
            break
        if counts[f] <= left:
            whole.append(f)
        else:
            cut = f
            break
        left -= counts[f]
    out = _accepted(spark, whole, field).select("text") if whole else spark.createDataFrame([], "text string")
    if cut is not None and left > 0:
        out = out.unionByName(_accepted(spark, [cut], field).orderBy("block", "row").limit(left).select("text"))
    return out


def split_formats(spark: SparkSession, out: str, splits: Sequence[str]) -> dict[str, str]:
    """The format of every split of a dataset below ``out/records``: jsonl if it has such files, else parquet."""
    formats = {}
    for split in splits:
        names = files_below(spark, f"{out}/records/split={split}")
        if any(n.endswith((".json", ".jsonl")) for n in names):
            formats[split] = "jsonl"
        elif any(n.endswith(".parquet") for n in names):
            formats[split] = "parquet"
        else:
            raise FileNotFoundError(f"Missing split file for {split}")
    return formats


def read_splits(spark: SparkSession, out: str, splits: Sequence[str], schema: T.StructType = STORED_SCHEMA) -> DataFrame:
    """A dataset in one plan, each split from its own format; a filter on ``split`` prunes the others' files."""
    parts = []
    for fmt, read, pattern in (("jsonl", read_jsonl, "*.json*"), ("parquet", read_parquet, "*.parquet")):
        mine = [s for s, f in split_formats(spark, out, splits).items() if f == fmt]
        for s in mine:
            df = read(spark, f"{out}/records/split={s}/{pattern}", schema)
            parts.append(df.withColumn("split", F.lit(s)))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole

