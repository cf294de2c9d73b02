"""Access to the input tables of a scale-factor directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
# Tables whose rows carry long text and drive per-row CPU work (splitting, tokenizing).
TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")


# Columns that tell a table's rows apart: rows are dealt by all of them.
KEYS = {"documents": ("doc_id",), "pages": ("page_id",), "conversations": ("conv_id", "turn"), "benchmark": ("item_id",)}


def spread_thin(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Spread an input with fewer scan partitions than the cluster has cores.

    A large input already arrives in many splits and is returned untouched; only a thin
    input (e.g. one Parquet row group) is redistributed, so the per-row text work is not
    serialised into one task.  Projections and filters are still pushed below it.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        # hash of the key columns: deterministic on retry, no pre-sort of the text, no long group in one task
        return df.repartition(target, *keys)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread_thin(df, KEYS[name]) if name in TEXT_TABLES else df
