"""Comparison of a query with its SQL on the same tables."""

import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def connect(path):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(path)):
        full = f"{path}/{name}"
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS FROM read_parquet('{full + '/*.parquet' if os.path.isdir(full) else full}')")
    return c


def same(df, relation):
    cols = sorted(df.columns)
    assert cols == sorted(relation.columns)
    own = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    names = relation.columns
    other = sorted(repr(tuple(norm(dict(zip(names, r, strict=True))[c]) for c in cols)) for r in relation.fetchall())
    assert own == other
