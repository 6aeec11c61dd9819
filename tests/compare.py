"""Runs a registered query and its DuckDB twin and compares their rows."""

from __future__ import annotations

import math
import os

import duckdb


def norm(x):
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return str([norm(y) for y in x])
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "NaT"):
        return "None"
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return str(bool(x))
    try:
        number = float(x) if not isinstance(x, str) else None
    except (TypeError, ValueError):
        number = None
    return str(x) if number is None else repr(round(number, 9) + 0.0)


def rows(frame, columns):
    return sorted(tuple(norm(v) for v in r) for r in frame[columns].itertuples(index=False))


def check(spark, name, query, sql, folder):
    got = query(spark, folder).toPandas()
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        path = f"{folder}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want = con.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns), name
    assert rows(got, columns) == rows(want, columns), name
