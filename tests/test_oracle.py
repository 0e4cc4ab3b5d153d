"""Every query of the core against its SQL twin in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from vexalith import queries as Q

#: Queries that the smallest tables may hold no case of.
RARE = {"unique_violations_existing"}
ORDERED = {n for n, (s, _) in Q.DIALECT.items() if "ORDER BY" in s}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(plain(r[i]) for i in order) for r in rows]


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_and_twin_agree(spark, sf, duck, name):
    df = Q.QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    cursor = duck.execute(Q.ORACLE[name])
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    assert sorted(df.columns) == sorted(names)
    if name not in ORDERED:
        got, want = sorted(got, key=repr), sorted(want, key=repr)
    assert want or name in RARE, "a twin without rows proves nothing"
    assert got == want


def test_every_query_runs_and_has_a_twin():
    assert set(Q.QUERIES) - set(Q.ORACLE) == {"ann_ivf", "ann_lsh"}
