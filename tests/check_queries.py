"""Run the registered queries beside their SQL: python tests/check_queries.py [folder] [name ...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def expected_rows(sql: str, folder: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con.execute(sql).df()


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs between two results, or None; row order does not count."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    got, want = normal(got), normal(want)
    for name in got.columns:
        if got[name].dtype != want[name].dtype and got[name].dtype.kind + want[name].dtype.kind not in ("if", "fi"):
            if got[name].dtype.kind != "O" and want[name].dtype.kind != "O" and len(got):
                return f"column {name}: {got[name].dtype} and {want[name].dtype}"
        a, b = got[name].astype(object), want[name].astype(object)
        unlike = ~((a == b) | (a.isna() & b.isna()))
        if unlike.any():
            i = unlike.idxmax()
            return f"column {name}, row {i}: {a[i]!r} and {b[i]!r}"
    return None


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as e
    from tests.session import local_session

    spark = local_session()
    bad = 0
    sql = e.oracle_sql()
    for name, query in e.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            got = query(spark, folder).toPandas()
            took = time.time() - started
            problem = difference(got, expected_rows(sql[name], folder)) if name in sql else "no SQL"
        except Exception as reason:
            took, problem = time.time() - started, str(reason)[:1500]
            got = []
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:28s} {len(got):7d} rows {took:6.2f} s  {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(main(where, sys.argv[2:]))
