"""Sinks for tokenizers, embedding tables and lexicons: the table, a manifest beside it, and a load that verifies.

  out/data/       the rows
  out/manifest/   one row: kind, rows, columns, order columns, content hash, caller's fields

The hash covers one canonical line a row in the order of ``order_cols``, as a rank tree, so it does not depend on
files or partitions and no task holds more than a node.  What a line is made of is the caller's choice;
it must be a function of the row, and is passed again on loading.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.hashing import rank_tree_hash


def json_line(df: DataFrame) -> Column:
    """The row as JSON with sorted keys: for columns of strings and integers."""
    return F.to_json(F.struct(*sorted(df.columns)))


def content(df: DataFrame, order_cols: Sequence[str], line: Column) -> DataFrame:
    """One row: (rows, content_hash); an empty table has no hash."""
    lines = df.select(*order_cols, line.alias("_line"))
    rows = lines.agg(F.count(F.lit(1)).alias("rows"))
    hashed = rank_tree_hash(lines, [], list(order_cols), "_line", "content_hash")
    return rows.join(hashed, F.lit(True), "left")  # one row each


def save(df: DataFrame, out: str, kind: str, order_cols: Sequence[str], line: Column | None = None, **fields: str) -> DataFrame:
    """Write the table, then the manifest of what was written; returns the manifest."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{out}/data")
    stored = spark.read.schema(df.schema).parquet(f"{out}/data")
    manifest = content(stored, order_cols, json_line(stored) if line is None else line).select(
        F.lit(kind).alias("kind"), "rows", "content_hash", F.lit(",".join(df.columns)).alias("columns"),
        F.lit(",".join(order_cols)).alias("order_cols"), *[F.lit(v).cast("string").alias(k) for k, v in sorted(fields.items())])
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest")
    return spark.read.parquet(f"{out}/manifest")


def verify(spark: SparkSession, out: str, line: Column | None = None) -> DataFrame:
    """One row: kind, rows, content_hash as declared, and whether the stored rows agree."""
    manifest = spark.read.parquet(f"{out}/manifest")
    m = manifest.first()
    data = spark.read.parquet(f"{out}/data")
    if data.columns != m["columns"].split(","):
        return manifest.select("kind", "rows", "content_hash", F.lit(False).alias("verified"))
    found = content(data, m["order_cols"].split(","), json_line(data) if line is None else line).first()
    same = found["rows"] == m["rows"] and found["content_hash"] == m["content_hash"]
    return manifest.select("kind", "rows", "content_hash", F.lit(same).alias("verified"))


def load(spark: SparkSession, out: str, line: Column | None = None) -> DataFrame:
    """The stored table, once it has been verified against its manifest."""
    try:
        state = verify(spark, out, line).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no artifact at {out}") from e
    if not state["verified"]:
        raise ValueError(f"{state['kind']} at {out} does not match its manifest")
    return spark.read.parquet(f"{out}/data")
