"""Pieces the training-data operators share: lineage cuts, packed blocks, word multisets, components.

The heavy joins here move *packed blocks*: a Python task turns a few thousand rows into one numpy
buffer per target bucket, so the JVM shuffles a few large binary rows instead of tens of millions
of small ones, and the bucket's task works on contiguous arrays. Buckets are sized by the number of
entries, so their memory stays the same at any scale.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import materialised

DIM = 128
WORD = re.compile(r"[^\W_]+")
#: Rows a task packs into one block; local row numbers are uint16.
BLOCK_ROWS = 8192


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` and drop its lineage, in the shared folder the session names."""
    return materialised(df)


def cut_and_released(rows: DataFrame) -> DataFrame:
    """Like ``cut``; the shuffle files that went into ``rows`` go at once, not when the driver collects its garbage."""
    out = cut(rows)
    plan, cleaner = rows._jdf.queryExecution().executedPlan(), rows.sparkSession.sparkContext._jsc.sc().cleaner()
    if cleaner.isDefined() and plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        for shuffle in list(plan.context().shuffleIds().keySet()):
            cleaner.get().doCleanupShuffle(shuffle, True)
    return out


def buckets_for(entries: int, per_bucket: int, least: int = 8) -> int:
    return max(least, -(-entries // per_bucket))


def runs(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, its positions) for each value that occurs, by one stable sort."""
    order = np.argsort(to, kind="stable")
    if not len(order):
        return
    start = np.flatnonzero(np.concatenate([[True], to[order[1:]] != to[order[:-1]]]))
    for lo, hi in zip(start, np.append(start[1:], len(order))):
        yield int(to[order[lo]]), order[lo:hi]


def batches(rows: Iterator[pa.RecordBatch], size: int = BLOCK_ROWS) -> Iterator[pa.Table]:
    """Regroup Arrow batches into tables of at most ``size`` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in rows:
        at = 0
        while at < b.num_rows:
            take = min(size - n, b.num_rows - at)
            held.append(b.slice(at, take))
            n += take
            at += take
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after lower-casing; null and empty text have none."""
    return WORD.findall(text.lower()) if text else []


class WordHash(dict):
    """Word -> 64-bit hash, remembered for the words a task has seen (bounded)."""

    LIMIT = 1_000_000

    def __missing__(self, w: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_rows(texts: list[str | None], seen: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of the texts, one after another, and the offsets of each text."""
    flat: list[int] = []
    off = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        flat.extend(map(seen.__getitem__, words(t)))
        off[i + 1] = len(flat)
    return np.array(flat, np.uint64), off


def occurrence_numbers(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each word its number among equal words of its row: makes a multiset a set."""
    order = np.lexsort((h, row))
    r, k = row[order], h[order]
    start = np.ones(len(h), bool)
    start[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    first = np.maximum.accumulate(np.where(start, np.arange(len(h)), 0))
    out = np.empty(len(h), np.int64)
    out[order] = np.arange(len(h)) - first
    return out


def vectors(column: pa.ChunkedArray | pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are usable, their float32 vectors).

    Usable: not null, exactly ``dim`` entries, all finite and none null, not all zero.
    """
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.list_(pa.float32()))
    n = len(col)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
    off = np.asarray(col.offsets).astype(np.int64)
    valid = np.asarray(col.is_valid()) & (np.diff(off) == dim)
    rows = np.flatnonzero(valid)
    if not len(rows):
        return rows, np.zeros((0, dim), np.float32)
    flat = col.values.cast(pa.float32()).to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    x = flat[off[:-1][rows, None] + np.arange(dim)]
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[good], np.ascontiguousarray(x[good])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision, safe for very large and very small entries."""
    y = x.astype(np.float64)
    y /= np.abs(y).max(1, keepdims=True)
    return y / np.sqrt((y * y).sum(1, keepdims=True))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of its component.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): every round is two
    aggregations over edges, their number never grows, and hub nodes are pre-aggregated by a
    map-side min. Each round's result is checkpointed.
    """
    cur = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    )
    last = None
    for _ in range(rounds):
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_m = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(small_m, "u")
        nxt = cut(
            step.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        sign = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        cur = nxt
        if sign == last:
            break
        last = sign
    else:
        raise RuntimeError("components did not converge")
    star = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = star.select(F.col("root").alias("node"), "root").distinct()
    return star.unionByName(roots)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
