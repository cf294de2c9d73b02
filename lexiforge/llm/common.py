"""Lineage cuts, stable keys and connected components shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.session import scratch_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: the lineage ends there.

    The shuffle files behind the write are dropped when it ends, not when the driver happens to collect
    garbage: nothing reads them again.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by `written` whose readers have all been written themselves."""
    for df in tables:
        spark, path = df.sparkSession, df._written_to
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def crc_of(col: str) -> Column:
    """crc32 of a value as text; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def unit(*cols: Column, seed: int = 0) -> Column:
    """A uniform double in [0, 1) that is a pure function of the columns (52 bits of a hash)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12) / F.lit(float(2**52))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: (node, root), root the least node.

    Large-star and small-star rounds until the edge set is a set of stars.  Each round is two
    aggregations on the edges; a node of any degree is aggregated map-side and joined by a
    splittable join, never gathered.  Loops and repeated edges are allowed; an empty edge list
    gives an empty result.
    """
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                .where("u <> v").distinct(), "component-edges")
    before = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the aggregates are cut off so that the joins have plain shuffles, whose hot keys can be split
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "component-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "component-large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "component-low")
        small = (large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v").where("u <> v").distinct())
        small = written(small, "component-edges")
        release(e, least, large, low)  # only the last round's edges are kept on disk
        e = small
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
