"""Run queries next to their SQL and compare the rows. ``python -m tests.compare [name ...]``"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

import __spark_entry__ as catalogue

SF_DIR = os.environ.get("COMPARE_SF_DIR", "/root/testdata/sf0.01")


def database(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{file}')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}".replace("-0", "0") if v == 0 else f"{v:.9g}"
    return str(v)


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def difference(spark, con, name: str, sf_dir: str = SF_DIR) -> str | None:
    """What differs between the query and its SQL, or None."""
    df = catalogue.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    ours, theirs = _rows(df.columns, got), _rows(names, want.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    if wrong:
        a, b = wrong[0]
        return f"{len(wrong)} of {len(ours)} rows differ: {str(a)[:400]} against {str(b)[:400]}"
    return None


if __name__ == "__main__":
    from tests.conftest import build_session

    session, con = build_session(), database()
    bad = 0
    for name in sys.argv[1:] or catalogue.queries():
        start = time.time()
        try:
            found = difference(session, con, name)
        except Exception as e:
            found = f"{type(e).__name__}: {str(e)[:900]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - start:.1f}s {found or ''}")
    print("failed:", bad)
