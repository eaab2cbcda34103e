"""Rows of two engines brought to one form."""

import math
from decimal import Decimal


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (float, Decimal)):
        return round(float(x), 4)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def assert_same(df, duck, sql):
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    theirs = rows(names, found.fetchall())
    ours = rows(df.columns, df.collect())
    assert sorted(df.columns) == sorted(names)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            if isinstance(x, float) and isinstance(y, float):
                assert math.isclose(x, y, rel_tol=1e-4, abs_tol=2e-3), (a, b)
            else:
                assert x == y, (a, b)
