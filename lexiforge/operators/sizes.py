"""Is a table small enough to be sent to every executor?  Checked by bytes, not only by rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 << 20
ROW_BYTES = 32  # what a row costs besides its strings


def table_bytes(df: DataFrame) -> int:
    """About what the rows take in memory: string and array contents, and a constant for the rest (one aggregation)."""
    total = F.lit(ROW_BYTES).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            total = total + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            total = total + F.coalesce(F.octet_length(F.array_join(F.col(f.name).cast("array<string>"), "")), F.lit(0))
    return df.agg(F.sum(total)).first()[0] or 0


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(df) if table_bytes(df) <= limit else df
