"""Seeded, partition-independent random draws.

A draw is a pure function of the seed and the row's identity, so it never depends on how the data is
partitioned or on task retries, and any SQL engine with ``md5`` reproduces it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 60


def draw_key(*parts) -> Column:
    """Uniform BIGINT in [0, 2^60): the first 15 hex digits of md5 over the parts."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("bigint")


def draw_integer(modulus: Column, *parts) -> Column:
    """Uniform integer in [0, modulus)."""
    return draw_key(*parts) % modulus
