"""Runs a query and its SQL twin and compares their rows, columns sorted by name."""

from __future__ import annotations

import datetime
import glob
import math
import os
from collections import Counter

import duckdb

ROOT = os.environ.get("ADLENS_TESTDATA", "/root/testdata")


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else (round(x, 6) + 0.0)
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    if isinstance(x, bool):
        return x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return x


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def sql_rows(sql: str, root: str) -> tuple[list[str], Counter]:
    con = duckdb.connect(config={"threads": int(os.environ.get("ADLENS_THREADS", "0")) or os.cpu_count()})
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    out = con.execute(sql)
    columns = [d[0] for d in out.description]
    return sorted(columns), rows_of(columns, out.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    return sorted(df.columns), rows_of(df.columns, df.collect())
