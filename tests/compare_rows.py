"""Rows in a form that two engines can be compared by."""

from __future__ import annotations

import math


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6g}"
    if type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows(records, names):
    order = sorted(names)
    return sorted((tuple(plain(r[names.index(c)]) for c in order) for r in records), key=str)


def same(df, relation):
    got, want = [tuple(r) for r in df.collect()], relation.fetchall()
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows(got, df.columns) == rows(want, relation.columns)
