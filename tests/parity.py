"""Run registered queries next to their SQL oracles: ``python -m tests.parity [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _plain(value: object) -> object:
    if isinstance(value, float) and math.isfinite(value) and value == 0:
        return 0.0
    return value


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both give the same columns, kinds and rows; else what differs."""
    columns = sorted(spark_df.columns)
    left = [tuple(_plain(v) for v in r) for r in spark_df.select(*columns).collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} vs {sorted(names)}"
    order = [names.index(c) for c in columns]
    right = [tuple(_plain(r[i]) for i in order) for r in result.fetchall()]
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    for l_row, r_row in zip(sorted(left, key=_key), sorted(right, key=_key)):
        if l_row != r_row or [type(v) for v in l_row] != [type(v) for v in r_row]:
            return f"{str(l_row)[:300]} vs {str(r_row)[:300]}"
    return None


def main(argv: list[str]) -> int:
    from taleweave.session import local_session
    import __spark_entry__ as entry

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session(8)
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(fn(spark, sf), con, oracles[name])
            else:
                problem = None if fn(spark, sf).count() > 0 else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:28s} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
