"""Predicates against a model in plain Python, over NULLs and values of all kinds."""

from __future__ import annotations

import itertools
import re

import pytest
from pyspark.sql import functions as F

from vexalith.functions import predicates
from vexalith.plans.ast import Chain, Condition, Name, Select
from vexalith.plans.parser import parse
from vexalith.plans.planner import Scope

ROWS = [(1, 5, 5.0, "Abc", True), (2, None, None, None, None), (3, -1, 2.5, "a%c", False), (4, 7, 7.25, "", True), (5, 5, float(3), "aXbYc", None), (6, 0, 0.0, "tütörial", False)]
COLUMNS = ["i", "f", "t", "b"]
VALUES = [5, 2.5, "Abc", True, None, "a"]


def kind(v):
    return "bool" if isinstance(v, bool) else "num" if isinstance(v, (int, float)) else "text" if isinstance(v, str) else None


def equal(x, v):
    return (x is None and v is None) or (x is not None and v is not None and kind(x) == kind(v) and x == v)


def less(x, v, test):
    return x is not None and v is not None and kind(x) == kind(v) and kind(x) in ("num", "text") and test(x, v)


def like(x, p):
    if not isinstance(x, str) or not isinstance(p, str):
        return False
    return re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in p), x, re.I | re.S) is not None


MODEL = {
    "=": lambda x, v: equal(x, v[0]),
    "!=": lambda x, v: not equal(x, v[0]),
    "<": lambda x, v: less(x, v[0], lambda a, b: a < b),
    "<=": lambda x, v: less(x, v[0], lambda a, b: a <= b),
    ">": lambda x, v: less(x, v[0], lambda a, b: a > b),
    ">=": lambda x, v: less(x, v[0], lambda a, b: a >= b),
    "IN": lambda x, v: any(equal(x, w) for w in v),
    "NOT IN": lambda x, v: not any(equal(x, w) for w in v),
    "BETWEEN": lambda x, v: less(x, v[0], lambda a, b: a >= b) and less(x, v[1], lambda a, b: a <= b),
    "NOT BETWEEN": lambda x, v: not (less(x, v[0], lambda a, b: a >= b) and less(x, v[1], lambda a, b: a <= b)),
    "LIKE": lambda x, v: like(x, v[0]),
    "NOT LIKE": lambda x, v: not like(x, v[0]),
    "IS NULL": lambda x, v: x is None,
    "IS NOT NULL": lambda x, v: x is not None,
}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "id int, i long, f double, t string, b boolean").cache()


def cases():
    for column in range(4):
        for op in ("=", "!=", "<", "<=", ">", ">="):
            for v in VALUES:
                yield column, op, (v,)
        for op in ("LIKE", "NOT LIKE"):
            for v in ("%", "a%", "%C", "%b%", "a_c", "a%c", "%ü%ö%", "", 5, None):
                yield column, op, (v,)
        for op in ("IN", "NOT IN"):
            for v in ((5, "Abc"), (None,), (None, 7, 2.5), (True, "")):
                yield column, op, v
        for op in ("BETWEEN", "NOT BETWEEN"):
            for v in ((0, 6), (2.5, 5), ("A", "b"), (None, 5), ("a", 5)):
                yield column, op, v
        for op in ("IS NULL", "IS NOT NULL"):
            yield column, op, ()


def test_every_operator_against_the_model(frame):
    all_ = list(cases())
    resolve = Scope(frame).resolve
    out = frame.select("id", *[predicates.condition(Condition(Name(COLUMNS[c]), op, v), resolve).alias(f"c{n}") for n, (c, op, v) in enumerate(all_)]).collect()
    for row in out:
        source = ROWS[row["id"] - 1]
        for n, (c, op, v) in enumerate(all_):
            assert row[f"c{n}"] is MODEL[op](source[c + 1], v), (source, COLUMNS[c], op, v)


def test_and_or_go_from_left_to_right(spark):
    rows = [(n, *bits) for n, bits in enumerate(itertools.product([0, 1], repeat=3))]
    df = spark.createDataFrame(rows, "n int, a int, b int, c int")
    where = parse("SELECT * FROM t WHERE a = 1 OR b = 1 AND c = 1").statement
    assert isinstance(where, Select) and isinstance(where.where, Chain)
    got = {r["n"] for r in df.where(predicates.chain(where.where, Scope(df).resolve)).collect()}
    assert got == {n for n, a, b, c in rows if (a or b) and c}


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).select("id", F.col("id").cast("string").alias("s")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    where = parse("SELECT id FROM t WHERE id >= 3 AND s != 'x'").statement.where
    plan = df.where(predicates.chain(where, Scope(df).resolve)).select("id")._jdf.queryExecution().executedPlan().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(id,3)" in pushed and "EqualNullSafe(s,x)" in pushed
