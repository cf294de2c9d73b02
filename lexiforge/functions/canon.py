"""Canonical record lines: compact JSON with keys sorted at every level, nulls dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sorted_value(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        return F.struct(*[_sorted_value(c.getField(f.name), f.dataType).alias(f.name)
                          for f in sorted(dtype.fields, key=lambda f: f.name)])
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        return F.transform(c, lambda x: _sorted_value(x, dtype.elementType))
    return c


def canonical_line(df: DataFrame, columns: list[str]) -> Column:
    """``to_json`` of the named columns with every struct's fields in key order.

    Absent values are nulls and are left out, as an absent key would be.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    return F.to_json(F.struct(*[_sorted_value(F.col(n), fields[n]).alias(n) for n in sorted(columns)]))
