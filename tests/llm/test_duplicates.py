"""Problems 1 and 4 against brute force, with hot signatures and on empty tables."""

from __future__ import annotations

import numpy as np
import pytest

from vexalith.llm import alike, history
from vexalith.llm.history import repeats_of_history
from vexalith.llm.nearduplicates import group_pairs, near_duplicate_groups

from . import brute
from .conftest import SCHEMA, similar_docs


def groups_of(df):
    return {r["id"]: r["group_id"] for r in near_duplicate_groups(df).collect()}


def refusals_of(df):
    return {r["new_id"]: r["seen_id"] for r in repeats_of_history(df).collect()}


def test_few_links_lose_nothing(spark, monkeypatch):
    """Classes with more partners in a signature than LINKS: the second look brings the rest."""
    monkeypatch.setattr(alike, "LINKS", 2)
    monkeypatch.setattr(alike, "large_from", lambda cells: 1 << 20)
    rows = similar_docs(10, 60, hot=40)
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = brute.alike_pairs(rows)
    assert groups_of(df) == brute.grouped(pairs)
    assert refusals_of(df) == brute.refused(pairs)


@pytest.mark.parametrize("seed", [5, 6])
def test_groups_and_refusals_match_brute_force(spark, seed):
    rows = similar_docs(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    pairs = brute.alike_pairs(rows)
    assert len(pairs) > 50
    assert groups_of(df) == brute.grouped(pairs)
    assert refusals_of(df) == brute.refused(pairs)


def test_small_sets_by_subsets(spark, monkeypatch):
    """All sets small: every pair comes from two-word subsets."""
    monkeypatch.setattr(alike, "large_from", lambda cells: 1 << 20)
    rows = similar_docs(7)
    assert groups_of(spark.createDataFrame(rows, SCHEMA)) == brute.grouped(brute.alike_pairs(rows))


def test_hot_signatures_lose_nothing(spark, monkeypatch):
    """A group of near copies beyond HOT: the star and the second look find the same as all pairs."""
    monkeypatch.setattr(alike, "HOT", 4)
    monkeypatch.setattr(history, "HOT", 4)
    monkeypatch.setattr(alike, "large_from", lambda cells: 1 << 20)
    rows = similar_docs(8, 60, hot=40)
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = brute.alike_pairs(rows)
    assert groups_of(df) == brute.grouped(pairs)
    assert refusals_of(df) == brute.refused(pairs)


@pytest.mark.parametrize("large", [8, 1 << 20])
def test_tiles_of_hot_signatures_lose_nothing(spark, monkeypatch, large):
    """Inverted lists, and second looks, with more pairs than a tile: parts of 4 classes, each two of them a task."""
    for name, value in (("HOT", 4), ("LINKS", 2), ("TILE", 4)):
        monkeypatch.setattr(alike, name, value)
    monkeypatch.setattr(alike, "large_from", lambda cells: large)
    rows = similar_docs(12, 60, hot=40)
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = brute.alike_pairs(rows)
    assert groups_of(df) == brute.grouped(pairs)
    assert refusals_of(df) == brute.refused(pairs)


def test_packed_rows_follow_the_signatures_not_the_buckets():
    rng = np.random.default_rng(3)
    rows, sig = np.zeros(500, alike.TEXT_ROW), rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for buckets in (8, 1000, 200_000):
        packer = alike.Packer(alike.TEXT, buckets)
        packer.add(np.repeat(np.arange(500), 8), sig)
        got = list(packer.pack(rows))
        assert len(got) <= min(buckets, 4000)
        assert sum(len(b.column("sigs")[0].as_py()) // 4 for b in got) == 4000
        assert sum(len(b.column("rows")[0].as_py()) // alike.TEXT_ROW.itemsize for b in got) <= 4000


def test_many_copies_are_one_class(spark):
    text = " ".join(f"word{i}" for i in range(20))
    rows = [(i, [1.0] * 127 + [float(i % 2)], text, None, i // 50, 0, "", 0, 0) for i in range(1, 400)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert groups_of(df) == {i: 1 for i in range(1, 400)}
    assert refusals_of(df) == {i: 1 for i in range(2, 400)}


def test_empty_and_null_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert groups_of(empty) == {} and refusals_of(empty) == {}
    nulls = spark.createDataFrame([(i, None, None, None, None, None, None, None, None) for i in range(4)], SCHEMA)
    assert groups_of(nulls) == {} and refusals_of(nulls) == {}
    assert group_pairs(near_duplicate_groups(nulls)).count() == 0


def test_very_long_contents(spark):
    long = " ".join(f"z{i % 3000}" for i in range(12000))
    rows = [(1, None, long, None, 0, 0, "", 0, 0), (2, None, long + " more words", None, 1, 0, "", 0, 0), (3, None, "z1 " * 9000, None, 1, 0, "", 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert groups_of(df) == {1: 1, 2: 1}
    assert refusals_of(df) == {2: 1}


def test_stored_history_gives_what_the_replay_gives(spark, tmp_path):
    rows = similar_docs(9, 160)
    want = brute.refused(brute.alike_pairs(rows))
    got: dict[int, int] = {}
    for part in ([r for r in rows if r[4] is None or r[4] == 0], [], [r for r in rows if r[4] == 1], [r for r in rows if r[4] is not None and r[4] > 1]):
        h = history.History(spark, str(tmp_path / "history"), 1000)  # opened anew for every batch
        got |= {r["new_id"]: r["seen_id"] for r in h.add(spark.createDataFrame(part, SCHEMA)).collect()}
    assert got == want
    parts = h.catalog.state()["segments"].parts
    assert len(parts) == 2  # three batches: the first two are one segment


@pytest.mark.parametrize("members", [12, 17, 20, 40, 200])
def test_a_family_edited_at_every_fifth_word_is_refused_but_for_one(spark, members):
    rows = []
    for c in range(members):
        w = [f"f{k}" if k % 5 or not c else f"own{c}x{k}" for k in range(25)]
        rows.append((c + 1, None, " ".join(w), None, c // 30, 0, "", 0, 0))
    want = brute.refused(brute.alike_pairs(rows))
    assert len(want) == members - 1 and refusals_of(spark.createDataFrame(rows, SCHEMA)) == want


@pytest.mark.parametrize("sent", [64 << 20, 0])
def test_a_batch_reads_only_the_buckets_and_records_it_needs(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(history, "SENT", sent)
    h = history.History(spark, str(tmp_path / "history"), 2_000_000)  # 80 buckets
    text = lambda n: " ".join(f"n{n}w{k}" for k in range(10))
    reads = []
    for b in range(3):
        h.add(spark.createDataFrame([(b * 1000 + i, None, text(b * 1000 + i), None, b, 0, "", 0, 0) for i in range(60)], SCHEMA))
        small = spark.createDataFrame([(9000, None, text(5), None, b, 0, "", 0, 0)], SCHEMA)
        blocks = alike.signature_blocks(history.plain(small, "id", "content", "embedding").withColumn("label", history.F.lit(1)), (2_000_000, np.full(alike.COUNTER, 20), np.zeros(1 << 16, np.int64)), None, "new", 80, in_order=True)
        arrays = h.segments_for(blocks.where("kind = 0"))
        assert "PartitionFilters: [" in (plan := arrays._jdf.queryExecution().executedPlan().toString()) and "PartitionFilters: []" not in plan, plan
        reads.append((len(h.catalog.state()["segments"].parts), arrays.select(history.F.input_file_name()).distinct().count()))
    assert reads[2][0] == 2 and all(files <= 8 * parts for parts, files in reads), reads
    got = h.add(spark.createDataFrame([(9000, None, text(5), None, 9, 0, "", 0, 0), (9001, None, text(7777), None, 9, 0, "", 0, 0)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(5, 9000)]


def evenly_edited():
    """Near copies of short contents at a share of 0.80 with no run of four words in common, and reordered ones."""
    rows = []
    for words, at in ((10, (3, 6)), (11, (3, 7)), (15, (3, 7, 11))):
        base = [f"b{words}x{k}" for k in range(words)]
        for c in range(20):
            w = [f"own{words}x{c}x{k}" if c and k in at else x for k, x in enumerate(base)]
            rows.append(" ".join(w))
        rows.append(" ".join(base[::-1]))
    for c in range(30):
        w = [f"l{k}" for k in range(30)]
        for k in (4, 9, 14, 19, 24, 29):
            w[k] = f"other{c}x{k}" if c else w[k]
        rows.append(" ".join(w))
    return [(i + 1, None, t, None, i // 25, 0, "", 0, 0) for i, t in enumerate(rows)]


def test_short_and_shuffled_contents_are_found_in_the_replay(spark):
    rows = evenly_edited()
    want = brute.refused(brute.alike_pairs(rows))
    assert len(want) == len(rows) - 4
    assert refusals_of(spark.createDataFrame(rows, SCHEMA)) == want


def test_short_and_shuffled_contents_are_found_in_the_stored_history(spark, tmp_path):
    rows = evenly_edited()
    got: dict[int, int] = {}
    h = history.History(spark, str(tmp_path / "history"), 1000)
    for b in range(4):
        got |= {r["new_id"]: r["seen_id"] for r in h.add(spark.createDataFrame([r for r in rows if r[4] == b], SCHEMA)).collect()}
    assert got == brute.refused(brute.alike_pairs(rows))
