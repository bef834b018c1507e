"""Runs queries in Spark and their SQL in DuckDB over the same tables and compares all rows: python tests/compare.py FOLDER [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows_of(columns: list[str], rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str, query, sql: str) -> str:
    began = time.time()
    df = query(spark, folder)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    cur = con.execute(sql)
    theirs = rows_of([c[0] for c in cur.description], cur.fetchall())
    names = sorted(df.columns) == sorted(c[0] for c in cur.description)
    if names and mine == theirs:
        return f"ok   {name} {len(mine)} rows {took:.1f} s"
    differ = [(a, b) for a, b in zip(mine, theirs) if a != b][:3]
    return f"DIFF {name} {len(mine)} / {len(theirs)} rows, columns {sorted(df.columns)} / {sorted(c[0] for c in cur.description)}: {differ}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from stratavox.session import local_session

    session = local_session()
    base, wanted = sys.argv[1], sys.argv[2:]
    duck, oracle = connect(base), entry.oracle_sql()
    for key, run in entry.queries().items():
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        try:
            if key in oracle:
                print(compare(session, duck, base, key, run, oracle[key]), flush=True)
            else:
                t = time.time()
                print(f"rows {key} {run(session, base).count()} rows {time.time() - t:.1f} s (no SQL)", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {key}: {str(e)[:1500]}", flush=True)
