"""Holds a query's rows against those of its DuckDB twin."""

import datetime
import math
from pathlib import Path

import duckdb


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (datetime.date, bool)) or x is None:
        return x if not isinstance(x, datetime.date) else x.isoformat()
    return float(x) if hasattr(x, "as_tuple") else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf, build, sql):
    df = build(spark, sf)
    ours = rows_of(df.columns, df.collect())
    with duckdb.connect() as db:
        for p in Path(sf).glob("*.parquet"):
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        got = db.execute(sql)
        theirs = rows_of([c[0] for c in got.description], got.fetchall())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    near = lambda a, b: a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))
    wrong = [(a, b) for a, b in zip(ours[1], theirs[1], strict=True) if not all(map(near, a, b))]
    assert not wrong, wrong[:3]
