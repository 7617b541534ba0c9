"""A query's rows beside its SQL's, by the same tables."""

from collections import Counter
from pathlib import Path

import duckdb


def _plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def assert_same(df, sql: str, sf_dir: str) -> None:
    names, rows = duck(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    want, got = _bag(names, rows), _bag(df.columns, [tuple(r) for r in df.collect()])
    assert sum(got.values()) == len(rows)
    assert not (got - want), list((got - want).items())[:3]
