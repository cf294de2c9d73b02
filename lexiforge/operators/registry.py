"""Dataset registry: a table keyed by path with upsert and name derivation."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.operators.indexing import dense_index

SCHEMA = "pos long, path string, name string, manifest_hash string, created_utc string"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def entry_name(manifest_name, path) -> F.Column:
    """Name from the manifest, else the last path segment."""
    return F.coalesce(manifest_name, F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1))


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by ``path``: every existing row with that path takes the incoming name,
    manifest_hash and created_utc (other columns kept); new paths are appended after the
    existing rows in incoming order (``seq``); for repeated incoming paths the last wins."""
    last = Window.partitionBy("path").orderBy(F.desc("seq"))
    first = Window.partitionBy("path").orderBy("seq")
    inc = (incoming.withColumn("_first_seq", F.min("seq").over(first.rowsBetween(Window.unboundedPreceding,
                                                                                   Window.unboundedFollowing)))
           .withColumn("_r", F.row_number().over(last)).where(F.col("_r") == 1).drop("_r"))
    upd = inc.select("path", F.col("name").alias("_n"), F.col("manifest_hash").alias("_h"),
                     F.col("created_utc").alias("_c"))
    kept = (existing.join(upd, "path", "left")
            .select("pos", "path", F.coalesce("_n", "name").alias("name"),
                    F.coalesce("_h", "manifest_hash").alias("manifest_hash"),
                    F.when(F.col("_h").isNotNull(), F.col("_c")).otherwise(F.col("created_utc")).alias("created_utc")))
    base = existing.agg(F.coalesce(F.max("pos"), F.lit(-1))).first()[0]  # one scalar
    fresh = inc.join(existing.select("path").distinct(), "path", "left_anti")
    new = (dense_index(fresh, ["_first_seq", "path"], name="_nth").withColumn("pos", F.lit(base + 1) + F.col("_nth"))
           .select("pos", "path", "name", "manifest_hash", "created_utc"))
    return kept.unionByName(new)


def load(spark: SparkSession, base: str) -> DataFrame:
    """Latest version of a registry stored under ``base`` (versions are ``v=<n>``
    partitions); a missing store is an empty registry."""
    try:
        stored = spark.read.parquet(base)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark)
    latest = stored.agg(F.max("v").alias("v"))
    return stored.join(F.broadcast(latest), "v").drop("v").select(*[c.split(" ")[0] for c in SCHEMA.split(", ")])


def save(df: DataFrame, base: str) -> int:
    """Append ``df`` as a new version; readers of the previous version are unaffected."""
    spark = df.sparkSession
    try:
        last = spark.read.parquet(base).agg(F.max("v")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    version = 0 if last is None else int(last) + 1
    df.withColumn("v", F.lit(version)).write.mode("append").partitionBy("v").parquet(base)
    return version
