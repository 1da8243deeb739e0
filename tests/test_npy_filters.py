"""A NumPy scan that is asked for some rows reads the bytes of these."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sizeladder.sources import npy


@pytest.fixture
def folder(tmp_path):
    m = np.random.RandomState(0).normal(size=(5000, 4))
    (tmp_path / "m").mkdir()
    np.save(tmp_path / "m" / "a.npy", m[:3000])
    np.save(tmp_path / "m" / "b.npy", np.asfortranarray(m[3000:]))
    return str(tmp_path / "m"), m


def read_with(path, monkeypatch, **rows):
    """(rows by id, values read from files, partitions) of a reader."""
    values, real = [0], npy._rows
    monkeypatch.setattr(npy, "_rows", lambda f, header, s, e: (values.__setitem__(0, values[0] + (e - s) * 4), real(f, header, s, e))[1])
    reader = npy.NpyReader(path, 1000, **rows)
    parts = reader.partitions()
    got = {i: v for p in parts for b in reader.read(p) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    monkeypatch.setattr(npy, "_rows", real)
    return got, values[0], len(parts)


def test_bytes_shrink_with_the_rows_asked_for(folder, monkeypatch):
    path, m = folder
    everything, all_values, parts = read_with(path, monkeypatch)
    assert len(everything) == 5000 and all_values == 20000 and parts == 5
    got, values, parts = read_with(path, monkeypatch, low=2990, high=3010)
    assert sorted(got) == list(range(2990, 3010)) and values == 80 and parts == 2
    got, values, parts = read_with(path, monkeypatch, ids=[5, 7, 4000, 9999, -3, 7])
    assert sorted(got) == [5, 7, 4000] and values == 16 and parts == 2  # 5 to 7, and 4000
    assert all(np.array_equal(got[i], m[i]) for i in got)
    assert read_with(path, monkeypatch, ids=[])[:2] == ({}, 0) and read_with(path, monkeypatch, low=10 ** 9)[:2] == ({}, 0)


def test_options_of_a_scan(spark, folder):
    path, m = folder
    npy.register(spark)
    scan = lambda **o: spark.read.format("npy").options(rowsPerTask=700, **o).load(path)
    rows = scan(firstRow=2999, endRow=3002).orderBy("sample_id").collect()
    assert [r["sample_id"] for r in rows] == [2999, 3000, 3001] and all(np.array_equal(r["data"], m[r["sample_id"]]) for r in rows)
    assert scan(rowIds="1, 4999").count() == 2 and scan(rowIds="").count() == 0


def test_one_frame_serves_many_queries(spark, folder):
    path, _ = folder
    npy.register(spark)
    df = spark.read.format("npy").load(path)
    assert df.where("sample_id > 4990 and sample_id <= 4995 and sample_id <> 4993").count() == 4
    assert df.where("sample_id = 12 or data[0] > 1e9").count() == 1 and df.count() == 5000
    assert df.where(F.col("sample_id").isin(1, 4999)).count() == 2
