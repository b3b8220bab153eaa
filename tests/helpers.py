"""Small things the tests share."""

from __future__ import annotations

import math
import os


def rows(df, *cols):
    """The rows of a DataFrame as sorted tuples."""
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=lambda t: tuple((x is not None, str(x)) for x in t))


def order(found):
    return sorted(found, key=lambda t: tuple((x is not None, str(x)) for x in t))


def views(con, data):
    for f in os.listdir(data):
        path = f"{data}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def against_sql(spark, con, data, query, sql):
    """Assert that a query and its SQL give the same columns and rows."""
    df = query(spark, data)
    cols = sorted(df.columns)
    mine = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = [tuple(plain(r[i]) for i in at) for r in res.fetchall()]

    def key(t):
        return tuple((x is None, "" if isinstance(x, (int, float)) else str(x), x if isinstance(x, (int, float)) else 0) for x in t)

    assert sorted(mine, key=key) == sorted(theirs, key=key)
