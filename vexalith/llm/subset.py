"""Problem 3: a varied subset, by concave feature coverage in descending-threshold rounds.

A record's features are the ``NEAR`` centroids its embedding is closest to, weighted by how close,
and its category. The subset maximises the sum over features of the square root of the selected
mass, so a feature that is well covered adds little and a large group of similar records is not
taken again and again. In a round every task adds, against the mass of the records chosen so far
and its own additions, the records whose marginal gain exceeds the threshold; the driver goes
through these proposals once more in the order of their gain, keeps those that still exceed it, and
lowers the threshold when none of the tasks had more to propose.

What the driver holds is bounded: ``PROPOSALS`` records a round (more come in the next at the same
threshold), and ``HELD`` chosen ids, which then go to storage and out of the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, cut, table, unit, vectors
from .neighbours import kmeans, sampled

CENTROIDS = 256
NEAR = 3
#: Cells that category names are hashed to: a fixed number of features, whatever the categories.
CATEGORIES = 1024
CATEGORY_WEIGHT = 1.0
LOWER = 0.8
#: Records that tasks propose in a round, about; chosen ids that the driver holds.
PROPOSALS, HELD = 500_000, 500_000
FEATURES_SQL = "id long, f array<int>, w array<float>"


def features(docs: DataFrame, centroids: np.ndarray, id_col: str, embedding_col: str, category_col: str) -> DataFrame:
    """(id, f, w): feature numbers and weights of every record."""
    shared = docs.sparkSession.sparkContext.broadcast(centroids.astype(np.float32))
    name = F.coalesce(F.lower(F.trim(F.col(category_col))), F.lit("\x00"))
    source = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(embedding_col).alias("embedding"), F.pmod(F.xxhash64(name), F.lit(CATEGORIES)).cast("int").alias("category")
    ).where("id is not null")

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for t in batches(rows):
            n = t.num_rows
            f = np.full((n, NEAR + 1), -1, np.int32)
            w = np.zeros((n, NEAR + 1), np.float32)
            at, x = vectors(t.column("embedding"))
            if len(at) and len(c):
                s = unit(x).astype(np.float32) @ c.T
                k = min(NEAR, len(c))
                near = np.argsort(-s, axis=1, kind="stable")[:, :k]
                f[at, :k] = near
                w[at, :k] = np.maximum(np.take_along_axis(s, near, 1), 0) ** 2
            f[:, NEAR] = len(c) + t.column("category").to_numpy()
            w[:, NEAR] = CATEGORY_WEIGHT
            off = pa.array(np.arange(n + 1, dtype=np.int32) * (NEAR + 1))
            f[f < 0] = 0
            yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks(), pa.ListArray.from_arrays(off, pa.array(f.ravel())), pa.ListArray.from_arrays(off, pa.array(w.ravel()))], names=["id", "f", "w"])

    return source.mapInArrow(emit, FEATURES_SQL)


def gains(mass: np.ndarray, f: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What each record adds to the sum of square roots (its features are different ones)."""
    return (np.sqrt(mass[f] + w) - np.sqrt(mass[f])).sum(-1)


def swept(rows: Sequence[int], f: np.ndarray, w: np.ndarray, mass: np.ndarray, threshold: float, most: int) -> tuple[list[int], list[float]]:
    """(rows added one after another, their gains): each one's gain reaches the threshold when its turn comes.

    mass is changed. Roots are kept per feature: a row costs four of them.
    """
    m, out, gain = mass.tolist(), [], []
    root = [sqrt(x) for x in m]
    for r, fs, ws in zip(rows, f[rows].tolist(), w[rows].tolist()):
        g = 0.0
        for i, x in zip(fs, ws):
            g += sqrt(m[i] + x) - root[i]
        if g >= threshold:
            for i, x in zip(fs, ws):
                m[i] += x
                root[i] = sqrt(m[i])
            out.append(r)
            gain.append(g)
            if len(out) == most:
                break
    mass[:] = m
    return out, gain


def by_gain(ids: np.ndarray, g: np.ndarray, least: float) -> np.ndarray:
    """Rows of at least that gain, the greatest first, ties by id."""
    rows = np.flatnonzero(g >= least)
    return rows[np.lexsort((ids[rows], -g[rows]))]


def varied_subset(docs: DataFrame, size: int, id_col: str = "id", embedding_col: str = "embedding", category_col: str = "category") -> DataFrame:
    """(id, rank, gain) of ``size`` records, or of all if there are fewer.

    Categories count without case and surrounding blanks; a null category is one of its own.
    Records with an unusable embedding take part by their category alone. Ties go to the less id;
    ids must be unique, records of null id are left out; an empty table gives no rows; other columns
    are ignored. size has no bound; an id is chosen once.
    """
    if size < 0:
        raise ValueError("size must not be negative")
    spark = docs.sparkSession
    result = "id long, rank long, gain double"
    total = docs.count() if size else 0
    if not total:
        return spark.createDataFrame([], result)
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(embedding_col).alias("embedding"))
    sample = sampled(named, total).astype(np.float32)
    c = kmeans(sample, min(CENTROIDS, max(1, len(sample) // 8)), 5) if len(sample) else np.zeros((0, 128), np.float32)
    c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    records = cut(features(docs, c, id_col, embedding_col, category_col))
    parts = max(1, records.rdd.getNumPartitions())
    mass = np.zeros(len(c) + CATEGORIES, np.float64)
    stored: DataFrame | None = None
    ids_held: list[int] = []
    gains_held: list[float] = []
    before = 0
    threshold = float((NEAR + CATEGORY_WEIGHT) * 1.0)

    def held() -> DataFrame:
        rows = pa.table({"id": pa.array(ids_held, pa.int64()), "rank": pa.array(np.arange(before + 1, before + len(ids_held) + 1)), "gain": pa.array(gains_held, pa.float64())})
        return spark.createDataFrame(rows, result)

    while before + len(ids_held) < size:
        left = size - before - len(ids_held)
        most = max(8, -(-min(2 * left, PROPOSALS) // parts))
        state = spark.sparkContext.broadcast((mass, np.sort(np.array(ids_held, np.int64)), threshold, most))

        def propose(rows: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            m, old, least, cap = state.value
            m = m.copy()
            for t in batches(rows, 1 << 16):
                ids, f, w = unpacked(t)
                new = ~np.isin(ids, old)
                ids, f, w = ids[new], f[new], w[new]
                pick = np.array(swept(by_gain(ids, gains(m, f, w), least), f, w, m, least, cap)[0], np.int64)
                cap -= len(pick)
                yield packed(ids[pick], f[pick], w[pick])
                if cap <= 0:
                    break

        ids, f, w = unpacked(records.mapInArrow(propose, FEATURES_SQL).toArrow())
        state.unpersist()
        picked, gain = swept(by_gain(ids, gains(mass, f, w), threshold), f, w, mass, threshold, left) if len(ids) else ([], [])
        ids_held += ids[picked].tolist()
        gains_held += gain
        if not picked:
            if threshold < 1e-9:
                break
            threshold = threshold * LOWER if threshold > 1e-6 else 0.0
        elif len(ids_held) >= HELD:
            done = cut(held())
            stored = done if stored is None else stored.unionByName(done)
            records = cut(without(records, ids_held))
            before, ids_held, gains_held = before + len(ids_held), [], []
    return held() if stored is None else stored.unionByName(held())


def unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f, w = (t.column(c).combine_chunks().flatten().to_numpy().reshape(-1, NEAR + 1) for c in ("f", "w"))
    return t.column("id").to_numpy(), f, w.astype(np.float64)


def packed(ids: np.ndarray, f: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    off = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * (NEAR + 1))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(off, pa.array(f.ravel())), pa.ListArray.from_arrays(off, pa.array(w.ravel().astype(np.float32)))], names=["id", "f", "w"])


def without(records: DataFrame, ids: list[int]) -> DataFrame:
    """The records but for these (at most about HELD) ids."""
    shared = records.sparkSession.sparkContext.broadcast(np.sort(np.array(ids, np.int64)))

    def keep(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in rows:
            yield t.filter(pa.array(~np.isin(t.column("id").to_numpy(), shared.value)))

    return records.mapInArrow(keep, FEATURES_SQL)


def p3_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fiftieth of the documents."""
    docs = table(spark, sf_dir, "docs")
    return varied_subset(docs, max(10, docs.count() // 50))
