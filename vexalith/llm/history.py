"""Problem 4: new batches against everything accepted before, by sorted arrays of signatures.

Pairs of contents are nominated by the two-word subsets and inverted lists of their prefixes
(``alike.py``), which miss no alike pair, however short or shuffled the contents are and however many
records hold the same words; embeddings by subsets of their signs. Runs of words as written miss
reordered and evenly edited contents; suffix arrays of contents written in one word order miss none,
but what they match grows with the square of the table (README).

The arrays are immutable, one for each batch, ordered by signature, in parts by ranges of hashes
(buckets). ``History`` keeps them in storage: a new batch's signatures are looked up by binary search
in the buckets they fall in, where these lie, and the contents of nominated records alone are read.
Arrays of like size are merged, so their number stays logarithmic. ``repeats_of_history`` replays all
batches of a table in one job.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import Catalog, Version, checkpoint_folder
from . import alike
from .alike import HOT, LIST, TEXT, VEC, candidates, checked, corpus_counts, plain  # noqa: F401 (tests lower HOT)
from .common import cut, table

#: Bytes of a batch's signatures that are sent to the stored arrays; folders that stored records lie in.
SENT, PLACES = 64 << 20, 256


def representatives(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, rep): follows the copy links (block's least id, then the class's) of one kind."""
    one = links.select(F.col("b").alias("id"), F.col("a").alias("r1"))
    two = links.select(F.col("b").alias("r1"), F.col("a").alias("r2"))
    return ids.join(one, "id", "left").join(two, "r1", "left").select("id", F.coalesce("r2", "r1", "id").alias("rep"))


def accept(order: DataFrame, pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, accepted, seen) for each record that is alike to any other; order: (id, batch).

    A record is accepted unless it is alike to an accepted one before it. In each round a record
    is accepted when all earlier ones it is alike to are refused, and refused when one of them is
    accepted; classes of copies exchange only their least undecided and least accepted record, so a
    large class costs no pairs.
    """
    touched = cut(pairs.where("kind >= 0").select(F.col("a").alias("id")).union(pairs.where("kind >= 10").select("b")).union(edges.select("a")).union(edges.select("b")).distinct())
    by_class = None
    for kind in (TEXT, VEC):
        reps = representatives(touched, pairs.where(F.col("kind") == kind + 10)).select("id", F.lit(kind).alias("kind"), "rep")
        by_class = reps if by_class is None else by_class.unionByName(reps)
    by_class = cut(by_class.join(order, "id").select("id", "kind", "rep", F.struct("batch", "id").alias("ord")))
    near = edges.select("kind", F.col("a").alias("rep"), F.col("b").alias("nb")).union(edges.select("kind", "b", "a"))
    near = cut(near.union(by_class.select("kind", "rep", F.col("rep").alias("nb"))).distinct())
    state = by_class.select("id", "ord").distinct().select("id", "ord", F.lit(0).alias("status"), F.lit(None).cast("long").alias("seen"))
    left = None
    while True:
        open_ = by_class.join(state.select("id", "status").where("status >= 0"), "id")
        least = open_.groupBy("kind", "rep").agg(F.min("ord").alias("m"), F.min(F.when(F.col("status") == 1, F.col("ord"))).alias("am"))
        around = near.join(least.withColumnRenamed("rep", "nb"), ["kind", "nb"]).groupBy("kind", "rep").agg(F.min("m").alias("m"), F.min("am").alias("am"))
        met = by_class.join(around, ["kind", "rep"], "left").groupBy("id", "ord").agg(F.min("m").alias("m"), F.min("am").alias("am"))
        state = cut(
            met.select(
                "id",
                "ord",
                F.when(F.col("am") < F.col("ord"), -1).when(F.col("m") == F.col("ord"), 1).otherwise(0).alias("status"),
                F.when(F.col("am") < F.col("ord"), F.col("am.id")).alias("seen"),
            )
        )
        now = state.where("status = 0").count()
        if not now:
            return state.select("id", (F.col("status") == 1).alias("accepted"), "seen")
        if now == left:
            raise RuntimeError("acceptance made no progress")
        left = now


def repeats_of_history(docs: DataFrame, id_col: str = "id", content_col: str = "content", embedding_col: str = "embedding", batch_col: str = "batch_no") -> DataFrame:
    """(seen_id, new_id) for every record not accepted, batches replayed in the order of batch, id.

    A record is refused when its content shares at least 0.80 of its words, or its embedding has a
    cosine of at least 0.98, with a record accepted before it; seen_id is the first such record.
    Null batches come before all others; null, empty or short contents and unusable embeddings
    repeat nothing; an empty table gives no rows; other columns are ignored; ids must be unique and
    rise with the batches; records of null id are left out.
    """
    order = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[batch_col].cast("long"), F.lit(-1)).alias("batch")).where("id is not null")
    batch = (F.coalesce(docs[batch_col].cast("long"), F.lit(-1)) * 2).alias("label")
    docs = plain(docs, id_col, content_col, embedding_col, batch)
    counts = corpus_counts(docs)
    if not counts[0]:
        return docs.select(F.col("id").alias("seen_id"), F.col("id").alias("new_id")).limit(0)
    pairs = candidates(docs, counts)
    edges = cut(checked(docs, pairs))
    state = accept(order, pairs, edges)
    if pairs.where("kind = -1").limit(1).count():
        # Hot signatures gave stars. Pairs with the accepted are added until they change nothing.
        before = -1
        while before != (before := edges.count()):
            known = state.where("accepted").select("id", F.lit(1).alias("kept"))
            touched = state.select("id", F.lit(1).alias("any"))
            now = order.join(known, "id", "left").join(touched, "id", "left").select(F.col("id").alias("node"), (F.col("batch") * 2 + F.coalesce("kept", F.when(F.col("any").isNull(), 1), F.lit(0))).alias("label"))
            more = candidates(docs.drop("label"), counts, now, "kept").where("kind >= 0").join(edges, ["kind", "a", "b"], "left_anti")
            edges = cut(edges.unionByName(checked(docs, more)).distinct())
            state = accept(order, pairs, edges)
    return state.where("not accepted").select(F.col("seen").alias("seen_id"), F.col("id").alias("new_id"))


SEGMENT_SQL = "kind int, rows binary, sigs binary, idx binary, bucket int"
RECORD_SQL = "id long, content string, embedding array<float>, place int"


def in_one(t: pa.Table) -> pa.Table:
    """The arrays of one bucket as one: blocks in order, or arrays of segments, merged."""
    kind, bucket = t.column("kind")[0].as_py(), t.column("bucket")[0].as_py()
    rows, sig, idx = read_blocks(t)
    order = np.argsort(sig, kind="stable")  # of ordered runs: a merge
    return pa.table({"kind": pa.array([kind], pa.int32()), "rows": [rows.tobytes()], "sigs": [sig[order].tobytes()], "idx": [idx[order].astype(np.uint32).tobytes()], "bucket": pa.array([bucket], pa.int32())})


def read_blocks(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(records, signatures, number of the record of each) of the blocks of one kind and bucket."""
    row = alike.VEC_ROW if t.column("kind")[0].as_py() == VEC else alike.TEXT_ROW
    rows = [np.frombuffer(x, row) for x in t.column("rows").to_pylist()]
    sig = [np.frombuffer(x, np.uint32) for x in t.column("sigs").to_pylist()]
    base = np.cumsum([0] + [len(x) for x in rows[:-1]])
    idx = [np.frombuffer(x, np.uint16 if len(x) == 2 * len(s) else np.uint32).astype(np.int64) + o for x, s, o in zip(t.column("idx").to_pylist(), sig, base)]
    return np.concatenate(rows), np.concatenate(sig), np.concatenate(idx)


def looked_up(new: pa.Table, old: pa.Table, large: int) -> pa.Table:
    """Candidate pairs (accepted id, new id) of one bucket: new signatures are searched for in each old array."""
    kind = new.column("kind")[0].as_py()
    rows, sig, idx = read_blocks(new)
    found = [np.zeros((2, 0), np.int64)]
    for n in range(old.num_rows):
        other, keys, at = read_blocks(old.slice(n, 1))
        lo, hi = np.searchsorted(keys, sig), np.searchsorted(keys, sig, "right")
        both = np.concatenate([rows, other])
        for i, j in alike.run_partners(lo, hi):
            x, y = idx[i], at[j]
            ok = alike.like_sketch(kind, both, x, y + len(rows))
            if kind == LIST:
                ok &= (rows["n"][x] >= large) | (other["n"][y] >= large)
            found.append(np.unique(np.stack([other["id"][y[ok]], rows["id"][x[ok]]]), axis=1))
    a, b = np.unique(np.concatenate(found, 1), axis=1)
    return pa.table({"kind": pa.array(np.full(len(a), VEC if kind == VEC else TEXT), pa.int32()), "a": pa.array(a), "b": pa.array(b)}, schema=alike.PAIRS)


class History:
    """What was accepted, kept in storage: one batch after another, no earlier one gone through again.

    ``add`` orders the signatures of the new batch only and looks them up in the stored arrays of
    accepted records; it stores arrays and records of what it accepts, both at once. After
    every second, fourth, ... batch arrays of like size are merged. expected: records to plan the
    buckets for. A batch is sent to the stored arrays if it takes up to ``SENT`` bytes, and meets the
    buckets it needs in a join otherwise.
    """

    def __init__(self, spark: SparkSession, path: str, expected: int = 10_000_000):
        self.spark, self.expected = spark, expected
        self.catalog = Catalog(spark, path)

    def _stored(self, name: str, schema: str) -> DataFrame:
        return self._read(self.catalog.state().get(name, Version(())).parts, schema)

    def _read(self, parts: Sequence[str], schema: str) -> DataFrame:
        """Partitioned folders as one; each is a root of its own."""
        out = self.spark.createDataFrame([], schema)
        for p in parts:
            one = self.spark.read.schema(schema).parquet(f"{self.catalog.path}/{p}")
            out = one if p == parts[0] else out.unionByName(one)
        return out

    def _part(self, name: str, rows: DataFrame, by: str) -> str:
        place = f"{name}/{uuid.uuid4().hex}"
        rows.write.partitionBy(by).parquet(f"{self.catalog.path}/{place}")
        return place

    def _order(self, new: DataFrame) -> np.ndarray:
        """Counts of words, which order them: those of the first batch, for all batches the same."""
        parts = self.catalog.state().get("order", Version(())).parts
        if parts:
            return np.frombuffer(self.spark.read.parquet(f"{self.catalog.path}/{parts[0]}").first()["cells"], np.int32).astype(np.int64)
        return np.minimum(corpus_counts(new)[1], (1 << 31) - 1)

    def segments_for(self, blocks: DataFrame) -> DataFrame:
        """The stored arrays of the buckets that the blocks fall in; the other partitions are not read."""
        met = [r["bucket"] for r in blocks.select("bucket").distinct().collect()]
        return self._stored("segments", SEGMENT_SQL).where(F.col("bucket").isin(met))

    def records_for(self, pairs: DataFrame) -> DataFrame:
        """The stored records of the places that candidates lie in."""
        met = [r["place"] for r in pairs.select(F.pmod("a", F.lit(PLACES)).cast("int").alias("place")).distinct().collect()]
        return self._stored("records", RECORD_SQL).where(F.col("place").isin(met)).drop("place")

    def _against_stored(self, blocks: DataFrame, large: int) -> DataFrame:
        blocks = blocks.where(F.col("kind").isin(TEXT, LIST, VEC))
        old = self.segments_for(blocks)
        size = blocks.agg(F.sum(F.length("rows") + F.length("sigs") + F.length("idx"))).first()[0] or 0
        if size > SENT:
            return blocks.groupBy("kind", "bucket").cogroup(old.groupBy("kind", "bucket")).applyInArrow(lambda n, o: looked_up(n, o, large) if n.num_rows and o.num_rows else alike.PAIRS.empty_table(), alike.PAIRS_SQL)
        shared = self.spark.sparkContext.broadcast(blocks.toArrow())

        def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            new = shared.value
            at = {}
            for n, key in enumerate(zip(new.column("kind").to_pylist(), new.column("bucket").to_pylist())):
                at.setdefault(key, []).append(n)
            for b in rows:
                t = pa.Table.from_batches([b])
                for n, key in enumerate(zip(t.column("kind").to_pylist(), t.column("bucket").to_pylist())):
                    if key in at:
                        yield from looked_up(new.take(at[key]), t.slice(n, 1), large).to_batches()

        return old.mapInArrow(search, alike.PAIRS_SQL)

    def add(self, batch: DataFrame, id_col: str = "id", content_col: str = "content", embedding_col: str = "embedding") -> DataFrame:
        """(seen_id, new_id) of the batch's records that repeat an accepted one, of it or of before.

        ids must be unique over all batches and rise with them. An empty batch changes nothing;
        nulls, short contents and other columns are as in ``repeats_of_history``.
        """
        new = cut(plain(batch, id_col, content_col, embedding_col))
        cells = self._order(new)
        counts = (self.expected, cells, np.zeros(1 << 16, np.int64))
        buckets = max(8, self.expected // 25_000)
        blocks = cut(alike.signature_blocks(new.withColumn("label", F.lit(1).cast("long")), counts, None, "new", buckets, in_order=True))
        large = alike.large_from(cells)
        pairs = cut(alike.nominated(blocks, large, "new").unionByName(self._against_stored(blocks, large)).distinct())
        records = new.unionByName(self.records_for(pairs.where("kind >= 0").join(new.select(F.col("id").alias("a")), "a", "left_anti")))
        edges = cut(checked(records, pairs))
        ids = new.select("id", F.lit(1).cast("long").alias("batch"))
        order = ids.unionByName(edges.select(F.col("a").alias("id")).distinct().join(ids, "id", "left_anti").withColumn("batch", F.lit(0).cast("long")))
        state = accept(order, pairs, edges)
        refused = cut(state.where("not accepted").select(F.col("seen").alias("seen_id"), F.col("id").alias("new_id")))
        kept = cut(new.join(refused.select(F.col("new_id").alias("id")), "id", "left_anti"))
        if not kept.isEmpty():
            arrays = alike.signature_blocks(kept, counts, None, "new", buckets, in_order=True).where(F.col("kind").isin(TEXT, LIST, VEC)).groupBy("kind", "bucket").applyInArrow(in_one, SEGMENT_SQL)
            state = self.catalog.state()
            n = batches = state["segments"].next_id if "segments" in state else 1
            parts = [*(state["segments"].parts if "segments" in state else ()), self._part("segments", arrays, "bucket")]
            while n % 2 == 0:  # the last two are of like size
                two = self._read(parts[-2:], SEGMENT_SQL)
                parts, n = [*parts[:-2], self._part("segments", two.groupBy("kind", "bucket").applyInArrow(in_one, SEGMENT_SQL), "bucket")], n // 2
            state["segments"] = Version((), tuple(parts), batches + 1)
            if "order" not in state:
                state["order"] = Version((), (self.catalog.part("order", self.spark.createDataFrame([(bytearray(cells.astype(np.int32).tobytes()),)], "cells binary")),), 1)
            told = kept.withColumn("place", F.pmod("id", F.lit(PLACES)).cast("int"))
            state["records"] = Version((), (*(state["records"].parts if "records" in state else ()), self._part("records", told.repartition("place"), "place")), batches + 1)
            self.catalog.publish(state)
        return refused


def p4_batches(spark: SparkSession, sf_dir: str, loads: int = 4) -> DataFrame:
    """The batches of docs added to a stored history in a few loads, one after another: the rows of p4_found."""
    docs = table(spark, sf_dir, "docs")
    number = F.coalesce(F.col("batch_no"), F.lit(-1))
    numbers = [r["n"] for r in docs.select(number.alias("n")).distinct().orderBy("n").collect()]
    out = spark.createDataFrame([], "seen_id long, new_id long")
    history = History(spark, f"{checkpoint_folder(spark)}/history-{uuid.uuid4().hex}", max(1, docs.count()))
    for load in np.array_split(np.array(numbers, np.int64), loads):
        if len(load):
            out = out.unionByName(history.add(docs.where(number.between(int(load[0]), int(load[-1])))))
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_of_history(table(spark, sf_dir, "docs"))
