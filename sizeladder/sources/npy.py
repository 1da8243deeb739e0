"""NumPy array files as a Spark data source, split by row range.

A path is one ``.npy`` file or a folder of shards that follow each other in name order, on any file
system Arrow can open. Each task reads the bytes of its row range and nothing else. The options `firstRow`, `endRow` and
`rowIds` (numbers with commas) restrict a scan to some rows; the bytes of all others but small gaps are skipped. Filters of a query are
not pushed down by themselves: Spark 4.1 keeps what was pushed into a Python source with its DataFrame, so that a second query
on the same DataFrame would lose rows. The writer leaves one shard per partition and job.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

ROWS_PER_TASK = 1_000_000
BATCH_ROWS = 10_000
GAP_ROWS = 16  # rows between two wanted ones that are read along rather than skipped


def _resolve(path: str):
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _shards(path: str):
    system, path = _resolve(path)
    if system.get_file_info(path).type == fs.FileType.Directory:
        files = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".npy")]
        return system, sorted(files)
    return system, [path]


def _header(f):
    """(shape, column-major?, dtype, position of the first value)."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(f)
    return shape, fortran, dtype, f.tell()


def _rows(f, header, start: int, stop: int) -> np.ndarray:
    shape, fortran, dtype, at = header
    width = int(np.prod(shape[1:], dtype=np.int64))
    if fortran and width > 1:
        columns = []
        for j in range(width):
            f.seek(at + (j * shape[0] + start) * dtype.itemsize)
            columns.append(np.frombuffer(f.read((stop - start) * dtype.itemsize), dtype))
        return np.stack(columns, axis=1).astype(np.float64)
    f.seek(at + start * width * dtype.itemsize)
    flat = np.frombuffer(f.read((stop - start) * width * dtype.itemsize), dtype)
    return flat.reshape(stop - start, width).astype(np.float64)


class RowRange(InputPartition):
    def __init__(self, file: int, start: int, stop: int, offset: int):
        self.file, self.start, self.stop, self.offset = file, start, stop, offset


class NpyReader(DataSourceReader):
    """Rows whose id is at least `low`, below `high` and, where they are given, among `ids`."""

    def __init__(self, path: str, rows: int, low: int = 0, high: int | None = None, ids: list[int] | None = None):
        self.path, self.rows, self.low, self.high = path, rows, low, high
        self.ids = None if ids is None else np.unique(np.array(ids, dtype=np.int64))

    def _runs(self, start: int, stop: int) -> list[tuple[int, int, np.ndarray | None]]:
        """(first, last + 1, wanted ids) of the stretches of ids to read between two ids."""
        start = max(start, self.low)
        stop = stop if self.high is None else min(stop, self.high)
        if start >= stop:
            return []
        if self.ids is None:
            return [(start, stop, None)]
        ids = self.ids[(self.ids >= start) & (self.ids < stop)]
        parts = np.split(ids, np.flatnonzero(np.diff(ids) > GAP_ROWS) + 1) if len(ids) else []
        return [(int(p[0]), int(p[-1]) + 1, p) for p in parts]

    def partitions(self):
        out, offset = [], 0
        system, files = _shards(self.path)
        for number, file in enumerate(files):
            with system.open_input_file(file) as f:
                n = _header(f)[0][0]
            out += [RowRange(number, s, min(n, s + self.rows), offset) for s in range(0, n, self.rows)
                    if self._runs(offset + s, offset + min(n, s + self.rows))]
            offset += n
        return out or [RowRange(0, 0, 0, 0)] * bool(files)  # a scan of no rows still has a task

    def read(self, part: RowRange):
        system, files = _shards(self.path)
        with system.open_input_file(files[part.file]) as f:
            header = _header(f)
            for first, last, wanted in self._runs(part.offset + part.start, part.offset + part.stop):
                for s in range(first, last, BATCH_ROWS):
                    e = min(last, s + BATCH_ROWS)
                    block = _rows(f, header, s - part.offset, e - part.offset)
                    ids = np.arange(s, e, dtype=np.int64)
                    if wanted is not None:
                        chosen = np.isin(ids, wanted)
                        block, ids = block[chosen], ids[chosen]
                    ends = np.arange(0, len(ids) * block.shape[1] + 1, block.shape[1], dtype=np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(block.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["sample_id", "data"])


HEADER_BYTES = 128


def _header_bytes(rows: int, width: int) -> bytes:
    """A version 1.0 header."""
    text = "{'descr': '<f8', 'fortran_order': False, 'shape': (%d, %d), }" % (rows, width)
    return b"\x93NUMPY\x01\x00" + (HEADER_BYTES - 10).to_bytes(2, "little") + text.ljust(HEADER_BYTES - 11).encode() + b"\n"


class Shard(WriterCommitMessage):
    def __init__(self, part: str | None):
        self.part = part


class NpyWriter(DataSourceArrowWriter):
    """Shards of earlier jobs stay unless the write overwrites; names hold the job, so appends never collide.

    A task streams its batches into a file of values and, once it knows their number, puts the header in front of
    them in a second file. Commit renames these files; those of failed or repeated tasks are removed.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        system, folder = _resolve(path)
        before = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        self.before = [f.path for f in before if f.path.endswith(".npy")]
        # shards are read in name order, so a later job has a later number
        numbers = [int(n) for n in (f.rsplit("/", 1)[-1].split("-")[1] for f in self.before if f.rsplit("/", 1)[-1].count("-") == 2) if n.isdigit()]
        self.job = f"part-{max(numbers, default=-1) + 1:06d}"
        self.stage = f"{folder.rstrip('/')}/_stage-{uuid.uuid4().hex}"

    def write(self, batches) -> WriterCommitMessage:
        from pyspark import TaskContext
        system, _ = _resolve(self.path)
        out, rows, width, name = None, 0, 0, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                values = batch.column(batch.schema.get_field_index("data"))
                flat = values.flatten().to_numpy(zero_copy_only=False).astype("<f8", copy=False)
                if out is None:
                    system.create_dir(self.stage, recursive=True)
                    name = f"{self.stage}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                    out, width = system.open_output_stream(name), len(flat) // batch.num_rows
                if len(flat) != batch.num_rows * width:
                    raise ValueError("all rows of an array must have the same length")
                out.write(flat.tobytes())
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        if name is None:
            return Shard(None)
        with system.open_input_stream(name) as values, system.open_output_stream(f"{name}.npy") as whole:
            whole.write(_header_bytes(rows, width))
            while block := values.read(1 << 22):
                whole.write(block)
        system.delete_file(name)
        return Shard(f"{name}.npy")

    def commit(self, messages) -> None:
        system, folder = _resolve(self.path)
        system.create_dir(folder, recursive=True)
        for m in messages:
            if m is None or m.part is None:
                continue
            number = m.part.rsplit("/", 1)[-1].split("-")[0]
            system.move(m.part, f"{folder.rstrip('/')}/{self.job}-{number}.npy")
        if self.overwrite:
            for old in self.before:
                system.delete_file(old)
        self._clear(system)

    def abort(self, messages) -> None:
        self._clear(_resolve(self.path)[0])

    def _clear(self, system) -> None:
        if system.get_file_info(self.stage).type == fs.FileType.Directory:
            system.delete_dir(self.stage)


class NpySource(DataSource):
    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "sample_id BIGINT, data ARRAY<DOUBLE>"

    def reader(self, schema):
        o = self.options
        ids = [int(i) for i in o["rowIds"].split(",") if i.strip()] if "rowIds" in o else None
        return NpyReader(o["path"], int(o.get("rowsPerTask", ROWS_PER_TASK)), int(o.get("firstRow", 0)), int(o["endRow"]) if "endRow" in o else None, ids)

    def writer(self, schema, overwrite):
        return NpyWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)
