"""Compare a query with its SQL: columns sorted by name, rows as sorted text."""

import math


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_plain, x)) + "]"
    if hasattr(x, "tolist"):
        return _plain(x.tolist())
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(_plain(r[k]) for k in order) for r in rows)


def same(df, con, sql):
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not bad, bad[:3]
