"""Rows of a Spark and a DuckDB result in one comparable form."""

import math


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def assert_same(df, con, sql):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    theirs = result.fetchall()
    cols = sorted(df.columns)
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[k]) for k in at) for r in theirs), key=repr)
    assert a == b
