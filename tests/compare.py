"""Run registered queries and their SQL side by side and compare the rows.

    python tests/compare.py [--sf DIR] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = queries()[name](spark, sf_dir)
    found = df.collect()
    sql = oracle_sql().get(name)
    if sql is None:
        return None if found else "no rows"
    wanted = con.execute(sql)
    columns = [c[0] for c in wanted.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(columns)}"
    ours, theirs = bag(df.columns, found), bag(columns, wanted.fetchall())
    if ours != theirs:
        return f"only spark: {list((ours - theirs).items())[:3]}; only sql: {list((theirs - ours).items())[:3]}"
    return None if found else "no rows"


if __name__ == "__main__":
    from conftest import new_session, release

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    session, connection = new_session(), connect(sf)
    bad = 0
    for query in args or queries():
        start = time.time()
        try:
            problem = compare(session, connection, query, sf)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{time.time() - start:6.2f}s {query}: {problem or 'ok'}", flush=True)
    release(session)
    print(f"{bad} problems")
