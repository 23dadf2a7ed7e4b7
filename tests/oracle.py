"""Run registered queries next to their SQL: ``python tests/oracle.py FOLDER [name ...]``."""

from __future__ import annotations

import importlib
import os
import sys
import time

import duckdb
import pandas as pd

TIMES: dict[str, float] = {}
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(value) -> str:
    if value is None or value is pd.NaT:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if value != value:
            return "null"
        return str(int(value)) if value == int(value) else repr(round(value, 6))
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, folder: str, queries, oracles) -> tuple[str, int]:
    began = time.time()
    df = queries[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    TIMES[name] = time.time() - began
    if name not in oracles:
        return "rows-only", len(got)
    result = con.execute(oracles[name])
    columns = [c[0] for c in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(columns)}", len(got)
    if got == want:
        return "ok", len(got)
    only_got = [r for r in got if r not in set(want)][:3]
    only_want = [r for r in want if r not in set(got)][:3]
    return f"DIFF {len(got)} vs {len(want)}\n   spark {only_got}\n   sql   {only_want}", len(got)


def main() -> None:
    from articleflow.session import build_session

    entry = importlib.import_module("__spark_entry__")
    folder, names = sys.argv[1], sys.argv[2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark = build_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = []
    picked = [n for n in queries if not names or n in names or f"@{queries[n].__module__.split('.')[-1]}" in names]
    for name in picked:
        began = time.time()
        try:
            verdict, n = compare(spark, con, name, folder, queries, oracles)
        except Exception as problem:  # report and go on
            verdict, n = f"ERROR {type(problem).__name__}: {str(problem)[:900]}", 0
        if not verdict.startswith(("ok", "rows-only")):
            bad.append(name)
        print(f"{name:24s} {n:7d} rows {TIMES.get(name, 0):6.2f}s of {time.time() - began:6.2f}s {verdict}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
