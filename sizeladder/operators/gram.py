"""Cross-moment (Gram) sufficient statistics by cell, and the dense solves on them.

The rows of a cell are spread over chunks of bounded size; every chunk is reduced to one small matrix
with numpy, and the matrices are summed row by row inside the JVM. What reaches a single task is one
matrix per cell, whose size depends on the number of features and never on the number of rows.

Products are taken around a pivot, the mean of the cell from a light pass before, so that columns with a large
offset and a small spread (keys, timestamps) keep all their digits. The pivot travels as row -1 of the matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_ROWS = 50_000
CHUNK_VALUES = 20_000_000  # doubles of one chunk (160 MB); wide rows make smaller chunks
HELD_VALUES = 20_000_000  # doubles of partial matrices a task holds (160 MB)


def fields(df: DataFrame, columns: list[str]) -> str:
    """DDL of some columns, for the schema of a grouped Arrow function."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {types[c]}" for c in columns)


def chunk_of(rows: Column, id_col: str = "sample_id", width: int = 1, size: int | None = None) -> tuple[Column, Column]:
    """(chunk number, number of chunks) for a cell of about `rows` rows of `width` values."""
    size = size or max(1, min(CHUNK_ROWS, CHUNK_VALUES // max(width, 1)))
    chunks = F.greatest(F.lit(1), F.ceil(rows / F.lit(size)).cast("int"))
    return F.pmod(F.xxhash64(id_col), chunks).cast("int"), chunks


def width_of(df: DataFrame, column: str = "x") -> int:
    """Features of the first row; all rows have as many."""
    first = df.select(F.size(column).alias("d")).first()
    return max(1, first["d"]) if first else 1


def matrix(column, rows: int) -> np.ndarray:
    """Arrow list column to a dense matrix without copying row by row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(rows, -1)


def vector(column) -> np.ndarray:
    return column.to_numpy().astype(float, copy=False) if isinstance(column, pa.ChunkedArray) \
        else column.to_numpy(zero_copy_only=False).astype(float, copy=False)


def repeat_keys(key, n: int) -> list:
    return [pa.array([k.as_py()] * n, k.type) for k in key]


def sum_vectors(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Element-wise sum of an array column; partial sums are made on the map side."""
    return (df.groupBy(*by).agg(Summarizer.sum(array_to_vector(F.col(column))).alias("_s"))
            .select(*by, vector_to_array("_s").alias(column)))


def _columns(table, inputs: list[str], is_array: dict[str, bool]) -> np.ndarray:
    """(1, inputs...) side by side."""
    n = table.num_rows
    parts = [np.ones((n, 1))]
    for name in inputs:
        col = table.column(name)
        parts.append(matrix(col, n) if is_array[name] else vector(col).reshape(n, 1))
    return np.hstack(parts)


def _matrix_rows(keys: list, g: np.ndarray, names: list[str], as_type=pa.Table):
    d = g.shape[0]
    return as_type.from_arrays(
        [*keys, pa.array(np.arange(d, dtype=np.int32)), pa.array(list(g), pa.list_(pa.float64()))],
        names=[*names, "i", "row"])


def _pivots(rows: DataFrame, cell: list[str], inputs: list[str]) -> DataFrame:
    """(cell..., pivot): the mean of every input column, with map-side partial means."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    side_by_side = F.concat(*[(F.col(c) if isinstance(kinds[c], T.ArrayType) else F.array(c)).cast("array<double>")
                              for c in inputs])
    return (rows.groupBy(*cell).agg(Summarizer.mean(array_to_vector(side_by_side)).alias("_m"))
            .select(*cell, vector_to_array("_m").alias("pivot")))


def _with_pivots(sums: DataFrame, pivots: DataFrame, cell: list[str]) -> DataFrame:
    head = pivots.select(*cell, F.lit(-1).alias("i"), F.concat(F.array(F.lit(0.0)), "pivot").alias("row"))
    return sums.unionByName(head)


def gram(rows: DataFrame, cell: list[str], inputs: list[str], chunk: Column, chunks: Column) -> DataFrame:
    """Gram matrix of (1, inputs... - pivot) per cell as (cell..., i, row): row i of the matrix, row -1 the pivot.

    `inputs` are DOUBLE or ARRAY<DOUBLE> columns; they are laid out side by side after the constant.
    Made for many cells of limited size: rows are shuffled to their (cell, chunk). `chunks`, from cell columns
    only, is the number of chunks, each of which gets a copy of its cell's pivot. Read back with
    :func:`gram_matrix`.
    """
    is_array = {f.name: isinstance(f.dataType, T.ArrayType) for f in rows.schema.fields}
    keyed = rows.select(*cell, chunk.alias("_chunk"), *inputs)
    keys = [*cell, "_chunk"]
    pivots = _pivots(rows, cell, inputs)
    own = [F.col(c).alias(c) for c in cell]  # new columns, as both sides come from the same table
    copies = pivots.select(*own, F.explode(F.sequence(F.lit(0), chunks - 1)).alias("_chunk"), "pivot")

    def partial(key, table, pivot):
        if not table.num_rows:
            return _matrix_rows(repeat_keys(key, 0), np.zeros((0, 0)), keys)
        m = _columns(table, inputs, is_array)
        m[:, 1:] -= np.asarray(pivot.column("pivot")[0].as_py(), dtype=float)
        return _matrix_rows(repeat_keys(key, m.shape[1]), m.T @ m, keys)

    schema = f"{fields(keyed, keys)}, i INT, `row` ARRAY<DOUBLE>"
    parts = keyed.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(partial, schema)
    return _with_pivots(sum_vectors(parts, [*cell, "i"], "row"), pivots, cell)


def table_gram(rows: DataFrame, cell: list[str], inputs: list[str]) -> DataFrame:
    """The same for few cells that span whole tables: every task adds up its own rows, nothing is moved.

    The pivots, one vector per cell, go to the tasks with the function. A task keeps one matrix per cell it meets
    and hands them over when they grow past HELD_VALUES.
    """
    is_array = {f.name: isinstance(f.dataType, T.ArrayType) for f in rows.schema.fields}
    narrow = rows.select(*cell, *inputs)
    pivots = _pivots(narrow, cell, inputs)
    known = {tuple(r[c] for c in cell): np.asarray(r["pivot"], dtype=float) for r in pivots.collect()}
    most = HELD_VALUES

    def add_up(batches):
        held = {}

        def hand_over():
            for g, sample in held.values():
                keys = [pa.array([v.as_py()] * g.shape[0], v.type) for v in sample]
                yield _matrix_rows(keys, g, cell, pa.RecordBatch)
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            for idx in batch.select(cell).to_pandas().groupby(cell, sort=False).indices.values():
                sample = [batch.column(c)[int(idx[0])] for c in cell]
                k = tuple(v.as_py() for v in sample)
                m = _columns(batch.take(pa.array(idx)), inputs, is_array)
                m[:, 1:] -= known[k]
                held[k] = (held[k][0] + m.T @ m, sample) if k in held else (m.T @ m, sample)
            if sum(g.size for g, _ in held.values()) > most:
                yield from hand_over()
        yield from hand_over()

    parts = narrow.mapInArrow(add_up, f"{fields(narrow, cell)}, i INT, `row` ARRAY<DOUBLE>")
    return _with_pivots(sum_vectors(parts, [*cell, "i"], "row"), pivots, cell)


def pivot_and_rest(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The pivot of one cell, and what its means exceed it by; their sum is the mean, rounded."""
    g = matrix(table.column("row"), table.num_rows)[np.argsort(table.column("i").to_numpy())]
    return g[0, 1:], g[1, 1:] / np.round(g[1, 0])


def gram_matrix(table: pa.Table) -> np.ndarray:
    """The rows of one cell back to moments: count at (0, 0), means along row and column 0, centred products else."""
    g = matrix(table.column("row"), table.num_rows)[np.argsort(table.column("i").to_numpy())]
    pivot, g = g[0, 1:], g[1:].copy()
    g[0, 0] = np.round(g[0, 0])  # vector sums are kept as mean times count
    off = g[0, 1:] / g[0, 0]  # mean less pivot: rounding only
    g[1:, 1:] -= g[0, 0] * np.outer(off, off)
    g[0, 1:] = g[1:, 0] = pivot + off
    return g


def raw_products(g: DataFrame, cell: list[str]) -> DataFrame:
    """(cell..., i, row) of the plain products of (1, inputs...)."""
    def restore(key, table):
        m = gram_matrix(table)
        n, mean = m[0, 0], m[0, 1:]
        m[1:, 1:] += n * np.outer(mean, mean)
        m[0, 1:] = m[1:, 0] = n * mean
        return _matrix_rows(repeat_keys(key, m.shape[0]), m, cell)

    return g.groupBy(*cell).applyInArrow(restore, f"{fields(g, cell)}, i INT, `row` ARRAY<DOUBLE>")


def spectrum(cov: np.ndarray):
    """Eigenvalues (numerically zero ones set to 0) and eigenvectors of a symmetric matrix."""
    values, vectors = np.linalg.eigh(cov)
    top = values[-1] if len(values) else 0.0
    return np.where(values > max(top, 0.0) * 1e-12, values, 0.0), vectors


def ridge_weights(values, vectors, cross, alpha: float) -> np.ndarray:
    """Weights of (C + alpha I) w = cross; directions without variance get weight 0 (least norm)."""
    denom = values + alpha
    inverse = np.where(values > 0, 1.0 / np.where(denom > 0, denom, 1.0), 0.0)
    return vectors @ (inverse[:, None] * (vectors.T @ cross))
