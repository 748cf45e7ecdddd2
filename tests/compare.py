"""Rows of both engines in a form that can be compared."""

import math
from decimal import Decimal


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}") + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
