"""Distances on their exact values, nearest neighbours against numpy, indexes by recall."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexalith.errors import QueryError
from vexalith.functions import distance
from vexalith.operators import accuracy, similarity
from vexalith.operators.index import IndexConfig, IVFIndex, LSHIndex

CASES = [
    ("euclidean", [0, 0], [3, 4], 25),
    ("euclidean", list(range(128)), list(range(1, 129)), 128),
    ("cosine", [1, 2], [2, 4], 0),
    ("cosine", [1, 0, 0], [0, 1, 0], 1),
    ("cosine", [1, 0], [-1, 0], 2),
    ("cosine", [0, 0], [1, 2], 0),
    ("dot", [1, 2, 3], [1, 1, 1], -6),
]


@pytest.mark.parametrize("metric,a,b,want", CASES)
def test_values(spark, metric, a, b, want):
    for kind in ("float", "double", "int", "bigint"):
        df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<double>, b array<double>").select(F.col("a").cast(f"array<{kind}>").alias("a"), F.col("b").cast(f"array<{kind}>").alias("b"))
        r = df.select(distance.between(metric, F.col("a"), F.col("b")).alias("x"), distance.to_query(metric, F.col("a"), b).alias("y")).first()
        assert r["x"] == pytest.approx(want, abs=1e-9) and r["y"] == pytest.approx(want, abs=1e-9)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 3, (12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(0, 1, 16)], i % 3) for i in range(600)]
    rows += [(600, None, 0), (601, [], 0), (602, [1.0] * 15, 0), (603, [None] + [1.0] * 15, 0), (604, [0.0] * 16, None), (605, list(rows[0][1]), 0)]
    return rows, spark.createDataFrame(rows, "id long, v array<double>, g int").repartition(4).cache()


def ranked(rows, q, k, keep=lambda r: True):
    good = [r for r in rows if r[1] is not None and len(r[1]) == 16 and None not in r[1] and keep(r)]
    return [i for _, i in sorted((sum((a - b) ** 2 for a, b in zip(r[1], q)), r[0]) for r in good)[:k]]


def test_nearest(vectors):
    rows, df = vectors
    q = rows[0][1]
    assert [r["id"] for r in similarity.nearest(df, "v", q, 12, tie="id").collect()] == ranked(rows, q, 12)
    assert [r["id"] for r in similarity.nearest(df.where("g = 1"), "v", q, 5, tie="id").collect()] == ranked(rows, q, 5, lambda r: r[2] == 1)
    assert similarity.nearest(df.limit(0), "v", q, 5).count() == 0
    got = {}
    for r in similarity.nearest_per_group(df, "v", q, "g", 3, tie=["id"]).orderBy("rank").collect():
        got.setdefault(r["g"], []).append(r["id"])
    assert got == {g: ranked(rows, q, 3, lambda r: r[2] == g) for g in (0, 1, 2, None)}
    for bad in ([], [math.nan] * 16):
        with pytest.raises(QueryError):
            similarity.nearest(df, "v", bad, 3)
    with pytest.raises(QueryError):
        similarity.nearest(df, "nope", q, 3)


def test_nearest_for_each_in_blocks(vectors, monkeypatch):
    rows, df = vectors
    monkeypatch.setattr(similarity, "QUERY_BYTES", 7 * 8 * 16)
    got = {}
    for r in similarity.nearest_for_each(df.where("id % 40 = 0 or id > 599"), df, "id", "id", "v", "v", 4).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["neighbour_id"])
    for i in [*range(0, 600, 40), 604, 605]:
        assert got[i] == ranked(rows, rows[i][1], 4)
    assert 600 not in got and 601 not in got and 603 not in got


def test_centroid(vectors):
    rows, df = vectors
    c = similarity.centroid(df.where("id < 600"), "v").first()["centroid"]
    assert c == pytest.approx(np.mean([r[1] for r in rows[:600]], 0).tolist())


def test_indexes_have_recall(spark, vectors, tmp_path):
    rows, df = vectors
    IVFIndex.build(df, "v", str(tmp_path / "ivf"), IndexConfig(n_probe=8))
    LSHIndex.build(df, "v", str(tmp_path / "lsh"), IndexConfig(n_bits=5, n_tables=12))
    ivf, lsh = IVFIndex.open(spark, str(tmp_path / "ivf")), LSHIndex.open(spark, str(tmp_path / "lsh"))
    hits = {"ivf": 0, "lsh": 0}
    for i in range(0, 600, 60):
        want = set(ranked(rows, rows[i][1], 10))
        hits["ivf"] += len(want & {r["id"] for r in ivf.search(rows[i][1], 10, tie=["id"]).collect()})
        hits["lsh"] += len(want & {r["id"] for r in lsh.search(rows[i][1], 10, tie=["id"]).collect()})
    assert hits["ivf"] >= 90 and hits["lsh"] >= 90
    with pytest.raises(QueryError):
        ivf.search([1.0], 3)
    with pytest.raises(QueryError):
        IVFIndex.build(df.limit(0), "v", str(tmp_path / "none"))
    each = {r["neighbour_id"] for r in ivf.search_each(df.where("id = 60"), "id", "v", "id", 10).collect()}
    assert each == {r["id"] for r in ivf.search(rows[60][1], 10, tie=["id"]).collect()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_search_reads_only_its_partitions_and_computes_a_distance_once(spark, vectors, tmp_path):
    rows, df = vectors
    ivf = IVFIndex.build(df, "v", str(tmp_path / "ivf"), IndexConfig(n_probe=3))
    found = ivf.search(rows[0][1], 5, tie=["id"])
    assert len(found.inputFiles()) and plan_of(found).count("ArrowEvalPython") == 1
    assert "PartitionFilters: [isnotnull(_cell" in plan_of(found) or "PartitionFilters: [_cell" in plan_of(found)
    for d in (similarity.nearest(df, "v", rows[0][1], 5), similarity.nearest_per_group(df, "v", rows[0][1], "id", 1)):
        assert plan_of(d).count("ArrowEvalPython") == 1


def test_accuracy(spark):
    exact = spark.createDataFrame([(1, 10, 1, 0.1), (1, 11, 2, 0.2), (2, 20, 1, 0.1), (2, 21, 2, 0.3)], "query_id int, neighbour_id int, rank int, distance double")
    found = spark.createDataFrame([(1, 99, 1, 0.2), (1, 10, 2, 0.3), (2, 20, 1, 0.1)], "query_id int, neighbour_id int, rank int, distance double")
    m = accuracy.measures(found, exact, 2).first()
    assert (m["recall"], m["precision"], m["mrr"], m["reciprocal_sum"]) == (0.5, 0.75, 0.75, 0.375)
    assert accuracy.distance_error(found, exact, 2).first()[0] == pytest.approx(0.2 / 3)
