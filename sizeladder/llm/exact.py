"""Vectors as exact integers, and exact sums of their products over Spark tasks.

Integers of a task are added up as Python integers of any size. They leave it as 32-bit limbs, whose sums over fewer than
2^31 tasks fit a bigint, so that totals are exact and do not depend on the order of tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers are kept within this bound; entries beyond it count as the bound.
MOST = 2 ** 62
LIMB = 32


def usable(vector: Column) -> Column:
    """A vector that is there, with entries that are all there and finite."""
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * c) of every entry as bigint."""
    most = F.lit(float(MOST))
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c * F.lit(float(scale)), most), -most)).cast("bigint"))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """A list column as rows x width; vectors of different widths are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    widths = np.diff(column.offsets.to_numpy()) if rows else np.zeros(0, dtype=int)
    if rows and widths.min() != widths.max():
        raise ValueError("vectors differ in width")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def limbs_of(m: np.ndarray, bits: int = 20) -> list[np.ndarray]:
    """Parts of `bits` bits, the last one signed, lowest first; each as double."""
    out = []
    while m.size and np.abs(m).max() >= 2 ** bits:
        out.append((m & (2 ** bits - 1)).astype(float))
        m = m >> bits
    return [*out, m.astype(float)]


def products(a: np.ndarray, b: np.ndarray, bits: int = 20) -> np.ndarray:
    """a.T @ b of two integer matrices as Python integers; every partial sum stays below 2^53."""
    total = np.zeros((a.shape[1], b.shape[1]), dtype=object)
    block = 2 ** (53 - 2 * bits)
    for i, low in enumerate(limbs_of(a, bits)):
        for j, high in enumerate(limbs_of(b, bits)):
            for s in range(0, len(a), block):
                part = (low[s:s + block].T @ high[s:s + block]).astype(np.int64).astype(object)
                total = total + part * (1 << (bits * (i + j)))
    return total


def limb_rows(place: list[tuple[int, ...]], values: list[int]) -> list[tuple[int, ...]]:
    """(place..., limb, value) rows of integers of any size."""
    out = []
    for where, v in zip(place, values):
        k = 0
        while not -2 ** (LIMB - 1) <= v < 2 ** (LIMB - 1):
            out.append((*where, k, v & (2 ** LIMB - 1)))
            v >>= LIMB
            k += 1
        out.append((*where, k, v))
    return out


def total(rows: DataFrame, place: list[str]) -> dict[tuple[int, ...], int]:
    """The integers by place, summed over all tasks. The caller bounds the number of places."""
    out: dict[tuple[int, ...], int] = {}
    for r in rows.groupBy(*place, "limb").agg(F.sum("value").alias("value")).collect():
        where = tuple(r[p] for p in place)
        out[where] = out.get(where, 0) + (r["value"] << (LIMB * r["limb"]))
    return out
