"""Deterministic keyed draws.

A draw is a pure function of its key (seed, split, index, slot, ...), so a row's
random choices never depend on partitioning, task retries or execution order.
The value is the first 52 bits of ``md5('k1|k2|...')`` scaled into [0, 1).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(2**52)


def _as_col(k) -> Column:
    return k if isinstance(k, Column) else F.lit(k)


def draw_key(*keys) -> Column:
    return F.concat_ws("|", *[_as_col(k).cast("string") for k in keys])


def uniform(*keys) -> Column:
    """Uniform double in [0, 1) keyed by ``keys`` (columns or literals)."""
    h = F.substring(F.md5(draw_key(*keys)), 1, 13)
    return F.conv(h, 16, 10).cast("bigint") / F.lit(_SCALE)


def randrange(n: Column | int, *keys) -> Column:
    """Uniform integer in [0, n) from the keyed draw (n > 0)."""
    return F.floor(uniform(*keys) * _as_col(n)).cast("long")
