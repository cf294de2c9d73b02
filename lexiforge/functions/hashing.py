"""Order-defined content hashes that never depend on partitioning.

``exact``: SHA-256 of the newline-joined lines in order (one group in one task; for
bounded groups such as vocabularies and lexicons).
``tree``: a three-level hash over ordinal buckets of FANOUT rows; every group that is
hashed in one task holds at most FANOUT short digests, so a split of any size is
hashed by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANOUT = 65536


def ordered_join(order, value, sep: str = "\n") -> Column:
    """Aggregate: values joined in ``order`` (an orderable column)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o") if isinstance(order, str) else order.alias("o"),
                                                 (F.col(value) if isinstance(value, str) else value).alias("v"))))
    return F.array_join(F.transform(pairs, lambda x: x["v"]), sep)


def ordered_hash(order, value) -> Column:
    """Aggregate: SHA-256 hex of the newline-joined values in order."""
    return F.sha2(ordered_join(order, value), 256)


def exact_hash(df: DataFrame, group_cols: list[str], order_col: str, line_col: str, name: str = "hash") -> DataFrame:
    return df.groupBy(*group_cols).agg(ordered_hash(order_col, line_col).alias(name))


def tree_hash(df: DataFrame, group_cols: list[str], ordinal_col: str, line_col: str,
              name: str = "hash", fanout: int = FANOUT) -> DataFrame:
    """Three-level hash; ``ordinal_col`` is a non-negative integer that orders the rows."""
    leaves = df.select(*group_cols, F.col(ordinal_col).alias("_o"), F.sha2(F.col(line_col), 256).alias("_h"))
    l1 = (leaves.withColumn("_b1", F.expr(f"_o div {fanout}"))
          .groupBy(*group_cols, "_b1").agg(ordered_hash("_o", "_h").alias("_h")))
    l2 = (l1.withColumn("_b2", F.expr(f"_b1 div {fanout}"))
          .groupBy(*group_cols, "_b2").agg(ordered_hash("_b1", "_h").alias("_h")))
    return l2.groupBy(*group_cols).agg(ordered_hash("_b2", "_h").alias(name))


def tree_hash_sql(table: str, group_cols: list[str], ordinal: str, line: str, name: str = "hash",
                  fanout: int = FANOUT) -> str:
    """The same definition as DuckDB SQL (used by the oracles and by tests)."""
    g = ", ".join(group_cols)
    gsel = (g + ", ") if g else ""
    gby = (", " + g) if g else ""
    return f"""
    (WITH _l1 AS (
        SELECT {gsel}{ordinal} // {fanout} AS b1,
               sha256(string_agg(sha256({line}), chr(10) ORDER BY {ordinal})) AS h
        FROM {table} GROUP BY b1{gby}),
     _l2 AS (
        SELECT {gsel}b1 // {fanout} AS b2, sha256(string_agg(h, chr(10) ORDER BY b1)) AS h
        FROM _l1 GROUP BY b2{gby})
     SELECT {gsel}sha256(string_agg(h, chr(10) ORDER BY b2)) AS {name} FROM _l2 {('GROUP BY ' + g) if g else ''})"""


def rank_tree_hash(df: DataFrame, group_cols: list[str], order_cols: list[str], line_col: str,
                   name: str = "hash", fanout: int = FANOUT) -> DataFrame:
    """Hash of each group's lines in the order of ``order_cols`` (unique in a group), of any type and any gaps.

    Leaves are runs of ``fanout`` ranks, and levels of ``fanout`` children are added until the group has
    one node, so no task holds more than that, whatever the order values are.  A group of at most
    ``fanout`` lines has one level, and no group's hash depends on another group.
    """
    from lexiforge.operators.indexing import dense_index

    lines = df.select(*group_cols, *order_cols, F.sha2(F.col(line_col), 256).alias("_h"))
    level = dense_index(lines, order_cols, group_cols, "_o").select(*group_cols, "_o", "_h")
    sizes = level.groupBy(*group_cols).agg((F.max("_o") + 1).alias("_m"))
    most = sizes.agg(F.max("_m")).first()[0] or 1
    level = level.join(sizes, group_cols) if group_cols else level.withColumn("_m", F.lit(most))
    leaves = True
    while leaves or most > 1:
        hashed = ordered_hash("_o", "_h")
        up = level.withColumn("_n", F.expr(f"_o div {fanout}")).groupBy(*group_cols, "_n").agg(
            (hashed if leaves else F.when(F.max("_m") == 1, F.min("_h")).otherwise(hashed)).alias("_h"),
            F.ceil(F.max("_m") / fanout).cast("long").alias("_m"))
        level, most, leaves = up.withColumnRenamed("_n", "_o"), -(-most // fanout), False
    return level.select(*group_cols, F.col("_h").alias(name))
