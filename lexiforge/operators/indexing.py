"""Distributed prefix sums and dense positions.

A plain ``row_number()`` over an unpartitioned (or hot) window sends every row through
one task.  Here rows are range-partitioned on (group, order), each task numbers its own
slice, and a small table of per-slice totals supplies the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lexiforge.operators.sizes import broadcast_if_small
from lexiforge.session import cut_lineage

ROW_BITS = 33  # of ``monotonically_increasing_id``: the number of the row in its partition


def prefix_sum(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = (),
               value: str | None = None, name: str = "pos") -> DataFrame:
    """Add ``name`` = sum of ``value`` (or count of rows) over the rows that precede each row
    in its group under ``order_cols``.  ``group_cols + order_cols`` must be unique.

    The range-partitioned slice is checkpointed so that the slice numbers used for the
    offsets and for the local sums are the same even if tasks are re-run.
    """
    keys = [*group_cols, *order_cols]
    whole = not value or isinstance(df.schema[value].dataType, IntegralType)  # integers are summed exactly
    v = (F.col(value) if value else F.lit(1)).cast("long" if whole else "double")
    sliced = cut_lineage(df.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id()).withColumn("_v", v))
    w_local = (Window.partitionBy("_slice", *group_cols).orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, -1))
    local = sliced.withColumn("_local", F.coalesce(F.sum("_v").over(w_local), F.lit(0)))
    totals = sliced.groupBy("_slice", *group_cols).agg(F.sum("_v").alias("_t"))
    w_off = Window.partitionBy(*group_cols).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_t").over(w_off), F.lit(0))).drop("_t")
    out = local.join(offsets, ["_slice", *group_cols], "inner")
    return out.withColumn(name, F.col("_off") + F.col("_local")).drop("_slice", "_v", "_local", "_off")


def dense_index(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = (),
                name: str = "pos") -> DataFrame:
    """0-based position of each row within its group, ordered by ``order_cols`` (unique).

    Rows are numbered where they were sorted, before the cut, so neither a window nor another shuffle of them
    follows: a group's numbers in a slice are consecutive, and a small table says what to add to them.
    """
    keys = [*group_cols, *order_cols]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = cut_lineage(ordered.withColumn("_slice", F.shiftright("_at", ROW_BITS)))
    spans = placed.groupBy("_slice", *group_cols).agg(F.count(F.lit(1)).alias("_t"), F.min("_at").alias("_first"))
    w_off = Window.partitionBy(*group_cols).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = cut_lineage(spans.select("_slice", *group_cols, (F.coalesce(F.sum("_t").over(w_off), F.lit(0)) - F.col("_first")).alias("_shift")))
    out = placed.join(broadcast_if_small(shifts), ["_slice", *group_cols], "inner")
    return out.withColumn(name, F.col("_at") + F.col("_shift")).drop("_slice", "_at", "_shift")
