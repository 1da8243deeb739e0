"""Run queries next to their checking SQL and compare values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_canon(r[i]) for i in order) for r in rows)


def check(spark, con, query, sql, sf_dir):
    """(problem or None, rows, seconds)."""
    t0 = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return (None if rows else "no rows"), len(rows), took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    other = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}", len(rows), took
    a, b = canonical(df.columns, rows), canonical(names, other)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    off = [(c, t, types[c]) for c, t in df.dtypes if kinds.get(t, t) != types[c]]
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"values: {len(a)} / {len(b)} rows; {sorted(names)} {diff}", len(rows), took
    return (f"types {off}" if off else None), len(rows), took


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from sizeladder.session import local_session
    sf_dir = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = local_session(os.environ.get("CPUS", 8))
    con = connect(sf_dir)
    queries, oracles = e.queries(), e.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name in sorted(queries):
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            problem, rows, took = check(spark, con, queries[name], oracles.get(name), sf_dir)
        except Exception as ex:  # report and go on
            problem, rows, took = f"{type(ex).__name__}: {str(ex)[:700]}", 0, 0.0
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name:34s} {rows:7d} rows {took:6.2f}s "
              f"{'' if name in oracles else '(rows only)'} {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
