"""Comparison of a query's rows with those of its SQL, by value and without order."""

from __future__ import annotations

import datetime
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, int):
        return float(x) if abs(x) < 1 << 53 else x
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    return x


def rows_of(frame) -> tuple[list[str], Counter]:
    names = sorted(frame.columns)
    return names, Counter(tuple(_plain(r[n]) for n in names) for r in frame.select(*names).collect())


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in got.fetchall())
