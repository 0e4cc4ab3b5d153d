"""Problems 2, 3 and 5 against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from vexalith.llm import neighbours, subset
from vexalith.llm.clusters import similarity_clusters
from vexalith.llm.neighbours import MultiIndex, build_index, kmeans, similar_vectors
from vexalith.llm.subset import varied_subset

from . import brute
from .conftest import SCHEMA, similar_docs


def clustered(seed: int, n: int = 500):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (25, 128))
    rows = similar_docs(seed, 40)
    at = rows[-1][0] + 1
    for i in range(n):
        v = centres[rng.integers(0, 25)] + rng.normal(0, 0.45, 128)
        rows.append((at + i, [float(x) for x in v], "t", ["big", "big", "small"][i % 3], 0, 0, "", 0, 0))
    for i in range(30):  # copies, some of them scaled
        rows.append((at + n + i, [float(x) * (1 + i % 2) for x in rows[-1][1]] if i else rows[60][1], "c", None, 0, 0, "", 0, 0))
    return rows


def test_neighbours_have_recall(spark):
    rows = clustered(3)
    ids, c = brute.cosines(rows)
    got = {}
    for r in similar_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["cosine"]))
    hits = wanted = 0
    for n, i in enumerate(ids):
        order = sorted((-c[n, m], ids[m]) for m in range(len(ids)) if m != n and c[n, m] >= 0.7)[:5]
        mine = sorted(got.get(i, []))
        assert len(mine) <= 5 and all(x >= 0.7 for _, _, x in mine)
        assert [x for _, _, x in mine] == sorted((x for _, _, x in mine), reverse=True)
        hits += len({b for _, b in order} & {b for _, b, _ in mine})
        wanted += len(order)
    assert wanted > 1000 and hits / wanted > 0.98


@pytest.mark.parametrize("noise", [0, 0.003])
def test_a_hot_group_hides_no_neighbours(spark, noise):
    """A third of the rows are copies or near copies of one vector: small groups around it stay whole."""
    rng = np.random.default_rng(5)
    hot = rng.normal(0, 1, (1, 128))
    groups = hot + 0.2 * rng.normal(0, 1, (76, 128))
    members = (groups[:, None] + 0.14 * rng.normal(0, 1, (76, 4, 128))).reshape(-1, 128)
    x = np.concatenate([hot, members, rng.normal(0, 1, (1500, 128)), hot + noise * rng.normal(0, 1, (900, 128))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = len(x) - 900
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(4)
    got = {}
    for r in similar_vectors(df, visit=400).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    s = u[:n] @ u[:n].T
    hits = wanted = 0
    for i in range(1, 305):
        closer = {j for j in np.argsort(-s[i])[:4].tolist() if j not in (0, i) and s[i, j] > s[i, 0]}
        hits += len(closer & got.get(i, set()))
        wanted += len(closer)
    assert wanted > 800 and hits / wanted > 0.995, (hits, wanted)


def test_cells_count_classes(spark):
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(0, 1, (50, 128)), np.ones((100, 128))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(4)
    assert build_index(df).size.sum() == 51


def test_clusters_match_brute_force(spark):
    rows = clustered(4)
    ids, c = brute.cosines(rows)
    pairs = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(c >= 0.7, 1)))]
    members, flow = similarity_clusters(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert {r["id"]: r["cluster_id"] for r in members.collect()} == brute.grouped(pairs)
    assert all(r["flow"] > 0 for r in flow.collect())


def test_dense_groups_joined_by_a_few_pairs_are_one_cluster(spark):
    """Two groups larger than a visit, which their own members use up, and a bridge between them."""
    rng = np.random.default_rng(8)
    a, b = np.linalg.qr(rng.normal(0, 1, (128, 2)))[0].T
    bridge = [np.cos(t) * a + np.sin(t) * b for t in np.linspace(0, np.pi / 2, 4)]
    noise = lambda c, n: c + 0.05 * rng.normal(0, 1, (n, 128))
    x = np.concatenate([noise(a, 400), noise(b, 400), np.stack(bridge), rng.normal(0, 1, (600, 128))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = np.argwhere(np.triu(np.round(u @ u.T, 6) >= 0.7, 1))
    members, _ = similarity_clusters(df, visit=60)
    assert {r["id"]: r["cluster_id"] for r in members.collect()} == brute.grouped(pairs.tolist())


def fitted(x, k, heavy=()):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    none = np.zeros(0, np.int64)
    f = u.astype(np.float32)
    ix = MultiIndex(kmeans(f[:, :64], k, 1), kmeans(f[:, 64:], k, 2), none, none, none, none, np.zeros((0, 128)), np.array([k * k]))
    ix.size = np.bincount(ix.cells(u), minlength=k * k)
    return u, ix


@pytest.mark.parametrize("k, n, visit", [(20, 300, 50), (258, 60_000, 4096), (258, 60_000, 30)])
def test_the_pairs_looked_at_give_the_order_of_the_heap(k, n, visit):
    """Also where a half's 49th, 100th, 200th centroid comes early, and beyond the first pops."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (25, 128))[rng.integers(0, 25, n)] + rng.normal(0, 0.8, (n, 128))
    u, ix = fitted(x, k)
    q, cell = ix.probes(u[:40], visit)
    a, b = ix.halves(u[:40])
    for i in range(40):
        fa, fb = a[i].argsort(kind="stable"), b[i].argsort(kind="stable")
        assert set(cell[q == i].tolist()) == set(ix.walked(a[i][fa].tolist(), b[i][fb].tolist(), fa, fb, visit).tolist())


def test_the_heap_goes_on_where_the_pairs_end(monkeypatch):
    rng = np.random.default_rng(2)
    u, ix = fitted(rng.normal(0, 1, (5000, 128)), 60)
    want = ix.probes(u[:20], 900)
    monkeypatch.setattr(neighbours, "MOST_POPS", 1)
    got = ix.probes(u[:20], 900)
    assert [sorted(want[1][want[0] == i]) for i in range(20)] == [sorted(got[1][got[0] == i]) for i in range(20)]


def test_reach_takes_the_fullest_buckets(monkeypatch):
    monkeypatch.setattr(neighbours, "REACH", 2)
    q, to, size = np.array([0, 0, 0, 0, 1, 1]), np.array([5, 6, 5, 7, 9, 8]), np.array([1, 3, 4, 2, 1, 1])
    assert neighbours.reached(q, to, size).tolist() == [True, True, True, False, True, True]


def test_a_hot_cell_is_divided_and_its_bucket_shared(spark, monkeypatch):
    """Near copies by the hundred in one cell, made heavy: lists by signs, buckets in parts; recall stays."""
    monkeypatch.setattr(neighbours, "HEAVY", 60)
    monkeypatch.setattr(neighbours, "BUCKET", 64)
    monkeypatch.setattr(neighbours, "PART", 40)
    rng = np.random.default_rng(6)
    hot = rng.normal(0, 1, 128)
    x = np.concatenate([rng.normal(0, 1, (300, 128)), hot + 0.05 * rng.normal(0, 1, (400, 128))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(4)
    index = build_index(df)
    assert len(index.heavy) and index.parts.max() > 1 and index.size[index.size.shape[0] - int(index.first[-1] - index.first[0]) :].sum() >= 300
    got = {}
    for r in similar_vectors(df).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hits = sum(len(set(np.argsort(-s[i])[:5].tolist()) & got.get(i, set())) for i in range(300, 700))
    assert hits / 2000 > 0.9, hits


def test_queries_take_turns(spark, monkeypatch):
    """However many buckets a query meets, a turn's blocks hold few copies of a vector; the rows stay."""
    rng = np.random.default_rng(9)
    n = 1500
    x = rng.normal(0, 1, (40, 128))[rng.integers(0, 40, n)] + 0.5 * rng.normal(0, 1, (n, 128))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(4)
    near = lambda: {(r["id"], r["neighbour"]) for r in similar_vectors(df).collect()}
    want, sent, routed = near(), [], neighbours.routed

    def counted(*args, **named):
        blocks = routed(*args, **named)
        sent.append(sum(len(r["entries"]) // neighbours.ENTRY.itemsize for r in blocks.select("entries").collect()))
        return blocks

    monkeypatch.setattr(neighbours, "routed", counted)
    monkeypatch.setattr(neighbours, "AT_ONCE", 1, raising=False)
    assert near() == want and len(want) > 4 * n
    assert max(sent) <= 5 * n < sum(sent)


def test_tables_without_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    nulls = spark.createDataFrame([(i, None, None, None, None, None, None, None, None) for i in range(4)], SCHEMA)
    for df in (empty, nulls):
        assert similar_vectors(df).count() == 0
        assert similarity_clusters(df)[0].count() == 0
    assert varied_subset(empty, 5).count() == 0
    assert varied_subset(nulls, 3).count() == 3


def objective(f, w, chosen):
    mass = np.zeros(f.max() + 1)
    np.add.at(mass, f[chosen].ravel(), w[chosen].ravel())
    return np.sqrt(mass).sum()


def greedy(f, w, size):
    mass, chosen, open_ = np.zeros(f.max() + 1), [], np.ones(len(f), bool)
    for _ in range(size):
        g = np.where(open_, subset.gains(mass, f, w), -1)
        r = int(g.argmax())
        chosen.append(r)
        open_[r] = False
        mass[f[r]] += w[r]
    return chosen


@pytest.mark.parametrize("held", [500_000, 7])
def test_subset_covers_as_well_as_the_greedy_one(spark, monkeypatch, held):
    """At least nine tenths of what the true greedy choice covers; also when ids go to storage by sevens."""
    monkeypatch.setattr(subset, "HELD", held)
    monkeypatch.setattr(subset, "PROPOSALS", 24 if held == 7 else 500_000)
    rows = clustered(5, 300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = varied_subset(df, 25).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 26)) and len({r["id"] for r in got}) == 25
    named = df.select("id", "embedding")
    sample = neighbours.sampled(named, df.count()).astype(np.float32)
    c = kmeans(sample, min(subset.CENTROIDS, len(sample) // 8), 5)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    ids, f, w = subset.unpacked(subset.features(df, c, "id", "embedding", "category").toArrow())
    at = {int(i): n for n, i in enumerate(ids)}
    mine = objective(f, w, [at[r["id"]] for r in got])
    assert mine >= 0.9 * objective(f, w, greedy(f, w, 25))
    assert mine == pytest.approx(sum(r["gain"] for r in got), rel=1e-4)
    rng = np.random.default_rng(0)
    assert mine > np.mean([objective(f, w, rng.choice(len(f), 25, replace=False)) for _ in range(10)])


def test_subset_sizes(spark):
    rows = clustered(6, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    assert varied_subset(df, 0).count() == 0
    assert varied_subset(df, 10_000).count() == len(rows)
    with pytest.raises(ValueError):
        varied_subset(df, -1)
