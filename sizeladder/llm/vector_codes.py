"""Vector code compression: product codes by active-entry Lloyd rounds on exact integers.

Entries become integers floor(4096 c), vectors are cut into 8 equal parts, and every part position has a codebook of 16
entries that starts with the vectors of the smallest ids. A round assigns all parts and then replaces every entry by the
floor of the mean of its parts. The state of a round, a table in the shared folder, holds per vector its integers and, per
part, the assigned entry and the exact squared distance to it. In the next round a part whose entry did not move keeps
this distance and looks only at the entries that moved: all others are as far as before, and lost before. A part whose
entry moved looks at all entries. Ties go to the lower entry either way, so codes equal those of full rounds.

A task adds up its parts per entry and appends the sums to the state it writes, so a round reads the vectors once. What
reaches the driver are 8 x 16 sums of vectors, whatever the number of rows; the codebooks travel with the tasks. A state is
removed when the next one is written; both lie in the shared folder, so a lost executor costs no more than its tasks.

Rows whose vector is null or has a null or non-finite component are dropped. Null ids are kept and come last when the first
entries are chosen; of rows that share an id the smaller vector comes first. With fewer rows than entries there are as many
entries as rows; entries without parts stay. An empty table gives an empty one. Vectors of different widths, or of a width
that the parts do not divide, are an error. Integers beyond 2^62 count as 2^62, errors beyond a bigint are null, as are sums
of errors. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, store
from .common import drop_table, small
from .exact import integers, limb_rows, matrix, products, total, usable

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LONGEST = 2 ** 63 - 1


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, as Python integers, and which of them moved when they were last replaced."""

    entries: list[list[list[int]]]
    moved: list[list[bool]] | None = None

    def sha256(self) -> str:
        """Of all components in decimal by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(v) for part in self.entries for e in part for v in e).encode()).hexdigest()


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest ids."""
    found = rows.orderBy(F.col("_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    vectors = [list(r["x"]) for r in found]
    if len({len(v) for v in vectors}) > 1:
        raise ValueError("vectors differ in width")
    width = len(vectors[0]) if vectors else 0
    if width % parts:
        raise ValueError(f"{parts} parts do not divide vectors of {width} components")
    w = width // parts
    return Codebooks([[v[p * w:(p + 1) * w] for v in vectors] for p in range(parts)])


def distances(x: np.ndarray, entries: list[list[int]]) -> np.ndarray:
    """Exact squared distances of rows to entries: in double where all sums are below 2^53, else as Python integers."""
    c = np.array(entries, dtype=object).reshape(len(entries), -1)
    far = (int(np.abs(x).max()) if x.size else 0) + max((abs(v) for v in c.ravel()), default=0)
    if far * far * max(1, c.shape[1]) * 4 < 2 ** 53:
        x, c = x.astype(float), c.astype(float)
        return ((x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    gap = x.astype(object)[:, None, :] - c[None]
    return (gap * gap).sum(axis=2)


def assign(x: np.ndarray, entries: list[list[int]], moved: list[bool] | None, code: np.ndarray | None,
           distance: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(entry, exact distance) of the rows of one part; `code` and `distance` are those of the round before."""
    if code is None:
        d = distances(x, entries)
        best = d.argmin(axis=1) if len(d) else np.zeros(0, dtype=int)  # the first of equal ones
        return best, d[np.arange(len(d)), best]
    code, distance = code.copy(), distance.copy()
    active = np.nonzero(moved)[0]
    if not len(active):
        return code, distance
    again = np.asarray(moved)[code]
    if again.any():
        code[again], d = assign(x[again], entries, None, None, None)
        distance = distance.astype(np.promote_types(distance.dtype, d.dtype))  # to Python integers where one needs them
        distance[again] = d
    rest = np.nonzero(~again)[0]
    if len(rest):
        near, d = assign(x[rest], [entries[e] for e in active], None, None, None)
        near = active[near]
        distance = distance.astype(np.promote_types(distance.dtype, d.dtype))
        closer = (d < distance[rest]) | ((d == distance[rest]) & (near < code[rest]))
        closer = closer.astype(bool)
        code[rest[closer]], distance[rest[closer]] = near[closer], d[closer]
    return code, distance


def _bigints(values: np.ndarray) -> pa.Array:
    """Distances as bigint; one beyond its range is -1 and is worked out again when it is needed."""
    flat = values.ravel()
    if flat.dtype != object:
        return pa.array(flat, pa.int64())
    return pa.array([int(v) if v <= LONGEST else -1 for v in flat], pa.int64())


def _lists(flat: pa.Array, rows: int, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), flat)


def one_round(state: DataFrame, books: Codebooks, sums: bool) -> DataFrame:
    """State after assigning all parts, with rows of sums per part, entry and position (-1: count) if asked for."""
    parts, kind, label = len(books.entries), state.schema["_id"].dataType.simpleString(), state.schema["_label"].dataType.simpleString()
    narrow = state.select("_id", "_label", "x", *([] if books.moved is None else ["code", "distance"]))
    names = ["_id", "_label", "x", "code", "distance", "part", "entry", "position", "limb", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], int] = {}
        schema = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = matrix(batch.column("x"), n).astype(np.int64)
            w = x.shape[1] // parts
            before, known = None, None
            if books.moved is not None:
                before = matrix(batch.column("code"), n).astype(np.int64)
                known = matrix(batch.column("distance"), n)
            code, distance = [], []
            for p in range(parts):
                own = x[:, p * w:(p + 1) * w]
                here = books.entries[p]
                old = None if known is None or (known[:, p] < 0).any() else known[:, p]
                a, d = assign(own, here, books.moved and books.moved[p], None if old is None else before[:, p], old)
                code.append(a), distance.append(d)
                if sums:
                    member = (a[:, None] == np.arange(len(here))).astype(np.int64)
                    added = products(member, np.hstack([np.ones((n, 1), dtype=np.int64), own]))
                    for (e, i), v in np.ndenumerate(added):
                        if v:
                            held[p, e, i - 1] = held.get((p, e, i - 1), 0) + int(v)
            as_object = any(d.dtype == object for d in distance)
            apart = np.stack([d.astype(object) if as_object else d for d in distance], axis=1)
            none = [pa.nulls(n, pa.int32())] * 4 + [pa.nulls(n, pa.int64())]
            out = pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_label"), batch.column("x"),
                 _lists(pa.array(np.stack(code, axis=1).astype(np.int32).ravel()), n, parts),
                 _lists(_bigints(apart), n, parts), *none], names=names)
            schema = out.schema
            yield out
        rows = limb_rows(list(held), list(held.values()))
        if rows:
            columns = [pa.array(c, pa.int64() if k == 4 else pa.int32()) for k, c in enumerate(zip(*rows))]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(rows), schema.field(c).type) for c in names[:5]], *columns], names=names)

    return narrow.mapInArrow(run, f"_id {kind}, _label {label}, x array<bigint>, code array<int>, distance array<bigint>, "
                                  "part int, entry int, position int, limb int, value bigint")


def replaced(books: Codebooks, sums: dict[tuple[int, int, int], int]) -> Codebooks:
    """Every entry with parts becomes the floor of their mean."""
    entries = [[e if not (n := sums.get((p, k, -1), 0)) else [sums.get((p, k, i), 0) // n for i in range(len(e))]
                for k, e in enumerate(part)] for p, part in enumerate(books.entries)]
    moved = [[a != b for a, b in zip(new, old)] for new, old in zip(entries, books.entries)]
    return Codebooks(entries, moved)


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """((`id_col`, `label_col`, code ARRAY<INT>, error), codebooks): per row the entry of every part and the summed error."""
    spark = table.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    state = table.where(usable(vector)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"),
                                               integers(vector, scale).alias("x"))
    books, path = first_codebooks(state, parts, entries), None
    for _ in range(rounds):
        earlier, path = path, scratch_path(spark, "codes")
        done = one_round(state, books, sums=True)
        done.write.parquet(path)
        written = spark.read.schema(done.schema).parquet(path)
        if earlier is not None:
            drop_table(spark, earlier)
        books = replaced(books, total(written.where("part is not null"), ["part", "entry", "position"]))
        state = written.where("part is null")
    last = one_round(state, books, sums=False)
    # an error that does not fit is found as a missing distance or as an overflow of the sum
    error = F.when(F.exists("distance", lambda d: d < 0), F.lit(None)).otherwise(
        F.aggregate("distance", F.lit(0).cast("bigint"), lambda a, d: F.try_add(a, d)))
    coded = store(last.select(F.col("_id").alias(id_col), F.col("_label").alias(label_col), "code", error.alias("error")), "coded")
    if path is not None:
        drop_table(spark, path)
    return coded, books


def label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds `label_error`, the error summed over equal labels, nulls together."""
    sums = coded.groupBy(F.col(label_col).alias("_l")).agg(
        F.when(F.count_if(F.col("error").isNull()) == 0, F.try_sum("error")).alias("label_error"))
    return coded.join(small(store(sums, "labels")), F.col(label_col).eqNullSafe(F.col("_l"))).drop("_l")


def code_text(code: str = "code"):
    """Two lower-case hex digits per part."""
    return F.concat_ws("", F.transform(code, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
