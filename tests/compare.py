"""Runs registered queries against DuckDB and reports differences.

    python -m tests.compare [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from __spark_entry__ import oracle_sql, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows), [names[i] for i in order]


def compare(spark, con, name: str, sf_dir: str, df=None) -> tuple[str | None, int, float]:
    """(difference or None, number of rows, seconds)."""
    start = time.time()
    df = queries()[name](spark, sf_dir) if df is None else df
    got, columns = _rows(df.columns, df.collect())
    seconds = time.time() - start
    sql = oracle_sql().get(name)
    if sql is None:
        return None, len(got), seconds
    result = con.execute(sql)
    want, wanted_columns = _rows([d[0] for d in result.description], result.fetchall())
    if columns != wanted_columns:
        return f"columns {columns} != {wanted_columns}", len(got), seconds
    if got == want:
        return None, len(got), seconds
    only_got = [r for r in got if r not in set(want)][:2]
    only_want = [r for r in want if r not in set(got)][:2]
    return (
        f"{len(got)} rows vs {len(want)}\n   got  {str(only_got)[:1500]}\n   want {str(only_want)[:1500]}",
        len(got),
        seconds,
    )


def main() -> None:
    from tracemill import session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = session.local(8), connect(sf_dir)
    bad = 0
    for name in args.names or queries():
        try:
            diff, n, seconds = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            diff, n, seconds = f"{type(e).__name__}: {str(e)[:1500]}", 0, 0.0
        bad += diff is not None
        kind = "" if name in oracle_sql() else " (rows only)"
        print(f"{'DIFF' if diff else 'ok':4} {name:32} {n:7} rows {seconds:6.2f}s{kind} {diff or ''}", flush=True)
    print(f"{bad} differences")


if __name__ == "__main__":
    main()
