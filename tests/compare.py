"""Results of Spark and DuckDB as comparable rows."""

from __future__ import annotations

import datetime
import decimal
import math


def cell(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    return x


def kind(x) -> str:
    return "float" if isinstance(x, (float, decimal.Decimal)) else type(x).__name__


def rows_of_spark(df):
    names = sorted(df.columns)
    got = [tuple(r[n] for n in names) for r in df.collect()]
    return names, got


def rows_of_duck(con, sql):
    cur = con.cursor().execute(sql)
    columns = [d[0] for d in cur.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, [tuple(r[i] for i in at) for r in cur.fetchall()]


def differences(df, con, sql) -> str:
    a, x = rows_of_spark(df)
    b, y = rows_of_duck(con, sql)
    if a != b:
        return f"columns {a} and {b}"
    for i, n in enumerate(a):
        kx, ky = ({kind(r[i]) for r in rows if r[i] is not None} for rows in (x, y))
        if kx and ky and kx != ky:
            return f"types of {n}: {kx} and {ky}"
    key = lambda r: tuple((v is None, str(v)) for v in r)
    x, y = (sorted((tuple(cell(v) for v in r) for r in rows), key=key) for rows in (x, y))
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows"
    bad = [(p, q) for p, q in zip(x, y) if p != q]
    return f"{len(bad)} of {len(x)} rows differ: {bad[:2]}" if bad else ""
