"""Problem 2: the most similar vectors for every vector, by an inverted multi-index.

Both halves of the unit vectors are quantised separately (k-means, fitted on a bounded sample); a
cell is a pair of half centroids and every vector is indexed in one. A query goes through centroid
pairs in the order of summed distance, skipping empty cells, until the cells hold ``visit``
different vectors (a crowded cell counts as an eighth of them at most), and the entries found are
reranked by their cosine.

The order is that of a heap of pairs (``walked``), found for many queries at once: of two sorted
rows the first t pairs by sum all have (i + 1) (j + 1) <= t, so these few sums are sorted; t grows
until the cells suffice, and beyond ``MOST_POPS`` the heap itself runs.

Cells of neighbouring centroids share a bucket (weighted bisection of the cell centres). A query
travels to the buckets its cells lie in, once each (of more than ``REACH`` to those that hold most of
what it goes through), and a bucket's task multiplies whole cells. Vectors travel as 16-bit components (the cosine changes by some 1e-6). Vectors equal in these are
one class with its least ids: a group of copies costs one query a block.

Hot groups: a cell of more than ``HEAVY`` different vectors is divided by the signs of its vectors
against its mean in fixed directions, so that no list grows with the table; a query goes through the
``NEAR_LISTS`` lists whose signs fit it best. A bucket of more than ``PART`` vectors is gone through by
several tasks, each with all its vectors and a share of its queries.

The copies of a query grow in number with the buckets it meets, what lies on disk does not: queries
take turns (``turns_for``), each with all its copies in one turn, and a turn's blocks are let go of
before the next one's are written. Every turn has all vectors at home.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, field
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alike import directions, ragged
from .common import BLOCK_ROWS, DIM, batches, cut_and_released, mix, runs, table, unit, vectors

#: Vectors, about, that the centroids are fitted on: so many, or so many a centroid; all vectors are indexed.
SAMPLE, SAMPLE_EACH = 16_384, 32
#: Different vectors a cell holds on average, while the centroids of a half are no more than MOST_CENTROIDS.
CELL, MOST_CENTROIDS = 16, 2048
#: Vectors of a bucket; vectors for whose queries a part of a bucket is there; buckets that a query goes to at most.
BUCKET, PART, REACH = 25_000, 32_768, 32
#: Copies of a query, on average, that travel in one turn, in tables of more than AT_ONCE of them;
#: vectors that the copies are counted on.
COPIES, AT_ONCE, COUNTED = 4, 65_536, 512
#: Pairs of centroids looked at first, and from which on the heap goes on.
POPS, MOST_POPS = 256, 1 << 14
#: Different vectors in the cells that a query goes through, and the share of them that one cell can count as.
VISIT = 4096
CROWD = 8
#: Different vectors from which on a cell is divided, about as many in each list; lists that a query goes through.
HEAVY, NEAR_LISTS = 1 << 16, 8
#: Directions the centres of cells are compared in when buckets are formed.
AXES = 16
#: Rows of a query block multiplied with a cell at once.
ROWS = 1024
LEAST_COSINE = 0.70
#: A cosine that rounds to LEAST_COSINE at six decimals is at least this much less.
HALF = 5e-7
HALF_DIM = DIM // 2
ENTRY = np.dtype([("h", "<u8"), ("x", "<i2", (DIM,))])
BLOCK_SQL = "bucket int, part int, entries binary, members binary, counts binary, cells binary, probes binary"
BLOCK = pa.schema([("bucket", pa.int32()), ("part", pa.int32())] + [(c, pa.binary()) for c in ("entries", "members", "counts", "cells", "probes")])


def visit_for(total: int, visit: int = VISIT) -> int:
    """Different vectors a query goes through: as many in a table of up to four million rows, then more."""
    return max(visit, int(visit * (total / 4_000_000) ** 0.5))


@dataclass
class MultiIndex:
    """The fitted index: half centroids, classes of equal vectors per cell, bucket of each cell.

    heavy: divided cells, sorted; mean: their centres; first: number of the first list of each and,
    at the end, of all. Lists are numbered after the cells; size and bucket go on with them.
    """

    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    bucket: np.ndarray
    parts: np.ndarray
    heavy: np.ndarray
    mean: np.ndarray
    first: np.ndarray
    sample: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM), np.float32))

    def halves(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the half centroids, up to what is the same for all of them."""
        x = u.astype(np.float32)
        return (
            (self.left * self.left).sum(1) - 2 * x[:, :HALF_DIM] @ self.left.T,
            (self.right * self.right).sum(1) - 2 * x[:, HALF_DIM:] @ self.right.T,
        )

    def cells(self, u: np.ndarray) -> np.ndarray:
        """The cell of each vector, or its list where the cell is divided."""
        a, b = self.halves(u)
        cell = a.argmin(1) * len(self.right) + b.argmin(1)
        for n, c in enumerate(self.heavy):
            at = np.flatnonzero(cell == c)
            if len(at):
                cell[at] = self.lists(n, u[at], 1)[:, 0]
        return cell

    def lists(self, n: int, u: np.ndarray, most: int) -> np.ndarray:
        """The lists of divided cell n that fit each vector best: its own signs, then the least certain ones changed."""
        count = int(self.first[n + 1] - self.first[n])
        bits = count.bit_length() - 1
        margin = (u - self.mean[n]).astype(np.float32) @ directions(bits, 77)
        code = ((margin > 0) * (1 << np.arange(bits))).sum(1)
        flips = min(bits, max(0, most.bit_length() - 1))
        doubtful = np.argsort(np.abs(margin), axis=1, kind="stable")[:, :flips]
        out = np.empty((len(u), 1 << flips), np.int64)
        for k in range(1 << flips):
            change = ((k >> np.arange(flips) & 1) << doubtful).sum(1) if flips else 0
            out[:, k] = self.first[n] + (code ^ change)
        return out

    def probes(self, u: np.ndarray, visit: int, own: np.ndarray | None = None, pure: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell), sorted by query, for all cells that each query goes through.

        own: a label of each query; cells whose vectors all have it (pure) are passed over like empty ones.
        """
        a, b = self.halves(u)
        fx, fy = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        x, y = np.take_along_axis(a, fx, 1), np.take_along_axis(b, fy, 1)
        rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        left, pops = np.arange(len(u)), POPS
        while len(left) and pops <= MOST_POPS:
            i, j = first_pairs(pops, x.shape[1], y.shape[1])
            whole = len(i) == x.shape[1] * y.shape[1]
            keep = len(i) if whole else pops
            step, still = max(1, (1 << 22) // len(i)), []
            for at in range(0, len(left), step):
                q = left[at : at + step]
                sums = x[q][:, i] + y[q][:, j]
                near = np.argpartition(sums, keep - 1, 1)[:, :keep] if keep < len(i) else np.broadcast_to(np.arange(len(i)), sums.shape)
                near = np.take_along_axis(near, np.take_along_axis(sums, near, 1).argsort(1), 1)
                cell = np.take_along_axis(fx[q], i[near], 1) * len(self.right) + np.take_along_axis(fy[q], j[near], 1)
                size = self.counted(self.size[cell], visit)
                if own is not None:
                    size = np.where(pure[cell] == own[q][:, None], 0, size)
                before = np.cumsum(size, 1) - size
                done = (before[:, -1] + size[:, -1] >= visit) | whole
                r, c = np.nonzero((size > 0) & (before < visit) & done[:, None])
                rows.append(q[r])
                cells.append(cell[r, c])
                still.append(q[~done])
            left, pops = np.concatenate(still), pops * 4
        for q in left:
            skip = None if own is None else pure == own[q]
            found = self.walked(x[q].tolist(), y[q].tolist(), fx[q], fy[q], visit, skip)
            rows.append(np.full(len(found), q))
            cells.append(found)
        row, out = np.concatenate(rows), np.concatenate(cells)
        for n, c in enumerate(self.heavy):
            at = np.flatnonzero(out == c)
            if len(at):
                lists = self.lists(n, u[row[at]], NEAR_LISTS)
                row = np.concatenate([np.delete(row, at), np.repeat(row[at], lists.shape[1])])
                out = np.concatenate([np.delete(out, at), lists.ravel()])
        order = np.argsort(row, kind="stable")
        return row[order], out[order]

    @staticmethod
    def counted(size: np.ndarray, visit: int) -> np.ndarray:
        """What cells use up of a visit."""
        return np.minimum(size, max(1, visit // CROWD))

    def walked(self, da: list[float], db: list[float], fa: np.ndarray, fb: np.ndarray, visit: int, skip: np.ndarray | None = None) -> np.ndarray:
        """The cells of one query, in the order of summed distance (in single precision), by a heap of pairs."""
        add = lambda i, j: (float(np.float32(da[i] + db[j])), i, j)
        heap, out, left = [add(0, 0)], [], visit
        while heap and left > 0:
            _, i, j = heappop(heap)
            cell = int(fa[i]) * len(self.right) + int(fb[j])
            if self.size[cell] and not (skip is not None and skip[cell]):
                out.append(cell)
                left -= int(self.counted(self.size[cell], visit))
            if j + 1 < len(db):
                heappush(heap, add(i, j + 1))
            if j == 0 and i + 1 < len(da):
                heappush(heap, add(i + 1, 0))
        return np.array(out, np.int64)


def first_pairs(pops: int, m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of a superset of the first ``pops`` pairs by sum of two ascending rows of m and n entries.

    When a pair is popped, all pairs that are no greater in both places are: (i + 1) (j + 1) <= pops.
    """
    i = np.arange(min(m, pops))
    width = np.minimum(pops // (i + 1), n)
    return np.repeat(i, width), ragged(width)


def coded(u: np.ndarray) -> np.ndarray:
    """Unit rows as 16-bit components, each row to its own scale."""
    return np.rint(u * (32767 / np.abs(u).max(1, keepdims=True))).astype(np.int16)


def hashed(code: np.ndarray) -> np.ndarray:
    """Hash of each row of 16-bit components: the class of its equal vectors."""
    return mix(mix(code.view(np.uint64) + mix(np.arange(1, DIM // 4 + 1, dtype=np.uint64))).sum(1))


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k centroids of the rows of x; an empty one moves to a random row."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        full = n > 0
        c[full] = np.add.reduceat(x[order], start[full]) / n[full, None]
        if (~full).any():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


def sampled(docs: DataFrame, total: int, size: int = SAMPLE) -> np.ndarray:
    """About ``size`` usable vectors as unit rows, chosen by a hash of the id."""

    def pick(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches(rows):
            _, x = vectors(t.column("embedding"))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["x"])

    part = docs if total <= size else docs.where(F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * size / total))
    got = part.select("embedding").mapInArrow(pick, "x binary").collect()
    return unit(np.concatenate([np.zeros((0, DIM), np.float32)] + [np.frombuffer(r["x"], np.float32).reshape(-1, DIM) for r in got]))


def bisected(centres: np.ndarray, weight: np.ndarray, parts: int) -> np.ndarray:
    """Part of each centre: halved again and again across the widest direction, by weight."""
    out = np.zeros(len(centres), np.int32)
    todo = [(np.arange(len(centres)), parts, 0)]
    while todo:
        rows, p, base = todo.pop()
        if p <= 1 or len(rows) <= 1:
            out[rows] = base
            continue
        x = centres[rows] - np.average(centres[rows], axis=0, weights=weight[rows])
        d = np.random.default_rng(3).standard_normal(x.shape[1])
        for _ in range(8):
            d = (x * weight[rows, None]).T @ (x @ d)
            d /= max(np.linalg.norm(d), 1e-30)
        order = np.argsort(x @ d, kind="stable")
        w = np.cumsum(weight[rows][order])
        at = min(max(1, int(np.searchsorted(w, w[-1] / 2))), len(rows) - 1)
        todo += [(rows[order[:at]], p // 2, base), (rows[order[at:]], p - p // 2, base + p // 2)]
    return out


def counted_cells(docs: DataFrame, index: MultiIndex, total: int) -> np.ndarray:
    """Different vectors in every cell and list. Equal vectors of a block count once before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(index))
    slices = max(8, -(-total // 65_536))

    def classes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The different vectors of a block as (cell, hash), by the remainder of the cell."""
        ix = MultiIndex(*shared.value)
        for t in batches(rows, BLOCK_ROWS):
            _, v = vectors(t.column("embedding"))
            if not len(v):
                continue
            code = coded(unit(v))
            h, first = np.unique(hashed(code), return_index=True)
            cell = ix.cells(unit(code[first]))
            got = [(b, np.stack([cell[at].view(np.uint64), h[at]]).tobytes()) for b, at in runs(cell % slices)]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], names=["part", "x"])

    def count(t: pa.Table) -> pa.Table:
        x = np.concatenate([np.frombuffer(v, np.uint64).reshape(2, -1) for v in t.column("x").to_pylist()], 1)
        x = x[:, np.lexsort((x[1], x[0]))]
        new = np.concatenate([[True], (x[:, 1:] != x[:, :-1]).any(0)])
        cell, n = np.unique(x[0, new].view(np.int64), return_counts=True)
        return pa.table({"x": pa.array([np.stack([cell, n]).tobytes()], pa.binary())})

    size = np.zeros(len(index.left) * len(index.right) + int(index.first[-1] - index.first[0]), np.int32)
    for r in docs.select("embedding").mapInArrow(classes, "part int, x binary").groupBy("part").applyInArrow(count, "x binary").toLocalIterator():
        cell, n = np.frombuffer(r["x"], np.int64).reshape(2, -1)
        size[cell] = n
    return size


def build_index(docs: DataFrame, seed: int = 11) -> MultiIndex | None:
    """Fits the centroids and counts the different vectors of every cell; None without usable vectors."""
    total = docs.count()
    k = int(np.clip(round((total / CELL) ** 0.5), 1, MOST_CENTROIDS))
    x = sampled(docs, total, max(SAMPLE, SAMPLE_EACH * k)).astype(np.float32)
    if not len(x):
        return None
    left, right = kmeans(x[:, :HALF_DIM], k, seed), kmeans(x[:, HALF_DIM:], k, seed + 1)
    n = len(left) * len(right)
    none = np.zeros(0, np.int64)
    index = MultiIndex(left, right, none, none, none, none, np.zeros((0, DIM)), np.array([n]))
    size = counted_cells(docs, index, total)
    heavy = np.flatnonzero(size > HEAVY)
    if len(heavy):
        of = index.cells(x)
        centre = lambda c: np.concatenate([left[c // len(right)], right[c % len(right)]])
        mean = np.stack([x[of == c].mean(0) if (of == c).any() else centre(c) for c in heavy])
        lists = 1 << np.ceil(np.log2(size[heavy] / HEAVY)).astype(np.int64)
        index = MultiIndex(left, right, none, none, none, heavy, mean, n + np.concatenate([[0], np.cumsum(lists)]))
        whole = size[heavy]
        size = counted_cells(docs, index, total)
    cells = np.concatenate([np.flatnonzero(size[:n]), np.arange(n, len(size))])
    of = np.concatenate([cells[cells < n], np.repeat(index.heavy, np.diff(index.first))])
    axes = np.linalg.svd(x[:SAMPLE] - x[:SAMPLE].mean(0), full_matrices=False)[2][:AXES].astype(np.float32)
    centres = (left @ axes[:, :HALF_DIM].T)[of // len(right)] + (right @ axes[:, HALF_DIM:].T)[of % len(right)]
    weight = size[cells].astype(np.float32) + 1e-6
    buckets = max(8, -(-int(size.sum()) // BUCKET))
    bucket = np.full(len(size), -1, np.int32)
    bucket[cells] = bisected(centres, weight, buckets)
    held = np.bincount(bucket[cells], size[cells], buckets)
    if len(heavy):
        size[heavy] = whole  # as the traversal counts them
    return MultiIndex(left, right, size, bucket, np.maximum(1, -(-held // PART)).astype(np.int32), index.heavy, index.mean, index.first, x[:: max(1, len(x) // COUNTED)])


def reached(q: np.ndarray, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the probes (query, bucket, vectors) lie in one of their query's REACH fullest buckets."""
    order = np.lexsort((to, q))
    new = np.concatenate([[True], (q[order][1:] != q[order][:-1]) | (to[order][1:] != to[order][:-1])])
    start = np.flatnonzero(new)
    total = np.add.reduceat(size[order], start)
    of = q[order][start]
    ranked = np.lexsort((-total, of))
    place = np.empty(len(start), np.int64)
    place[ranked] = np.arange(len(start)) - np.searchsorted(of, of)
    out = np.empty(len(q), bool)
    out[order] = (place < REACH)[np.cumsum(new) - 1]
    return out


def turns_for(index: MultiIndex, visit: int) -> int:
    """Turns in which COPIES of a query travel at once, as the sample meets buckets."""
    if not len(index.sample):
        return 1
    q, cell = index.probes(index.sample, visit)
    met = np.unique(np.stack([q, index.bucket[cell]]), axis=1)[0]
    total = int(index.size[index.bucket >= 0].sum())
    copies = np.minimum(np.bincount(met), REACH).mean() * total
    return max(1, int(np.ceil(copies / max(COPIES * total, AT_ONCE))))


@dataclass
class SecondLook:
    """Who looks again: the vectors of cell[n], as ones of label[n] (sorted by cell; a cell may have
    several labels). pure: the label of a cell all of whose vectors have it, else -1; such cells are
    passed over by those who look as ones of it."""

    cell: np.ndarray
    label: np.ndarray
    pure: np.ndarray

    def asking(self, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, label) for the vectors at home in these cells."""
        lo = np.searchsorted(self.cell, home)
        n = np.searchsorted(self.cell, home, "right") - lo
        return np.repeat(np.arange(len(home)), n), self.label[np.repeat(lo, n) + ragged(n)]


def routed(docs: DataFrame, index: MultiIndex, visit: int, again: SecondLook | None = None, turn: int = 0, turns: int = 1) -> DataFrame:
    """Blocks by bucket and part: classes with their vectors, ids of class members at home, cells to go through.

    Everything whose turn it is asks, or in a second look those it names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((astuple(index), None if again is None else astuple(again)))

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, again = MultiIndex(*shared.value[0]), shared.value[1] and SecondLook(*shared.value[1])
        most = int(ix.parts.max())
        for t in batches(rows, BLOCK_ROWS):
            at, x = vectors(t.column("embedding"))
            if not len(at):
                continue
            ids = t.column("id").to_numpy()[at]
            code = coded(unit(x))
            h = hashed(code)
            order = np.lexsort((ids, h))
            new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
            first = order[new]
            member_of = np.empty(len(h), np.int64)
            member_of[order] = np.cumsum(new) - 1
            entries = np.zeros(len(first), ENTRY)
            entries["h"], entries["x"] = h[first], code[first]
            u = unit(code[first])
            own = ix.cells(u)
            home = ix.bucket[own].astype(np.int64)
            if again is None:
                asking = np.flatnonzero((h[first] >> np.uint64(40)) % np.uint64(turns) == turn)
                q, cell = ix.probes(u[asking], visit)
                q = asking[q]
            else:
                asking, label = again.asking(own)
                q, cell = ix.probes(u[asking], visit, label, again.pure)
                q, cell = np.unique(np.stack([asking[q], cell]), axis=1)
            to = ix.bucket[cell].astype(np.int64)
            if len(ix.parts) > REACH:
                keep = reached(q, to, ix.size[cell])
                q, cell, to = q[keep], cell[keep], to[keep]
            part = (entries["h"][q] >> np.uint64(20)).astype(np.int64) % ix.parts[to]
            asks = dict(runs(to * most + part))
            # A bucket's vectors go to all its parts.
            count = ix.parts[home]
            held = dict((key, np.repeat(np.arange(len(first)), count)[at]) for key, at in runs(np.repeat(home * most, count) + ragged(count)))
            owned = dict(runs(home[member_of]))
            for key in sorted(asks.keys() | held.keys()):
                b, p = divmod(key, most)
                here = asks.get(key, np.zeros(0, np.int64))
                used = np.zeros(len(first), bool)
                used[q[here]] = True
                used[held.get(key, [])] = True
                local = np.cumsum(used) - 1
                mine = owned.get(b, np.zeros(0, np.int64)) if key in held else np.zeros(0, np.int64)
                members = np.stack([local[member_of[mine]], ids[mine]])
                counts = np.bincount(local[q[here]], minlength=int(used.sum())).astype(np.uint32)
                cells, number = np.unique(cell[here], return_inverse=True)
                number = number.astype(np.uint16 if len(cells) < 1 << 16 else np.uint32)
                parts = (entries[used], members, counts, cells.astype(np.int64), number)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([p], pa.int32())] + [pa.array([v.tobytes()], pa.binary()) for v in parts], schema=BLOCK)

    return docs.select("id", "embedding").mapInArrow(emit, BLOCK_SQL)


@dataclass
class Bucket:
    """One bucket's content with classes made unique. members: (class, id), sorted."""

    h: np.ndarray
    u: np.ndarray
    members: np.ndarray
    probes: np.ndarray
    cell: np.ndarray

    @staticmethod
    def read(t: pa.Table, index: MultiIndex) -> Bucket:
        entries = [np.frombuffer(v, ENTRY) for v in t.column("entries").to_pylist()]
        base = np.cumsum([0] + [len(e) for e in entries[:-1]])
        members = np.concatenate([np.frombuffer(v, np.int64).reshape(2, -1) + np.array([[o], [0]]) for v, o in zip(t.column("members").to_pylist(), base)], 1)
        counts = np.concatenate([np.frombuffer(v, np.uint32) for v in t.column("counts").to_pylist()]).astype(np.int64)
        probe = []
        for c, p in zip(t.column("cells").to_pylist(), t.column("probes").to_pylist()):
            c = np.frombuffer(c, np.int64)
            probe.append(c[np.frombuffer(p, np.uint16 if len(c) < 1 << 16 else np.uint32)])
        entries = np.concatenate(entries)
        h, first, of = np.unique(entries["h"], return_index=True, return_inverse=True)
        members[0] = of[members[0]]
        members = members[:, np.lexsort((members[1], members[0]))]
        probe = of[np.repeat(np.arange(len(counts)), counts)] * np.int64(1 << 32) + np.concatenate(probe)
        if len(h) < len(entries):
            probe = np.unique(probe)
        u = unit(entries["x"][first])
        cell = np.full(len(h), -1, np.int64)
        own = np.unique(members[0])
        cell[own] = index.cells(u[own])
        return Bucket(h, u.astype(np.float32), members, np.stack([probe >> 32, probe & 0xFFFFFFFF]), cell)

    def least_ids(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """(class, id): the keep least ids of every class at home."""
        c = self.members[0]
        start = np.concatenate([[True], c[1:] != c[:-1]])
        rank = np.arange(len(c)) - np.maximum.accumulate(np.where(start, np.arange(len(c)), 0))
        return c[rank < keep], self.members[1][rank < keep]


def best_of(s: np.ndarray, keep: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the keep greatest entries of each row, those of at least ``least``."""
    close = s >= least - HALF
    if s.shape[1] <= keep:
        return np.nonzero(close)
    n = np.count_nonzero(close, 1)
    full = np.flatnonzero(n > keep)
    if len(full):
        close[full] = False
    r, c = np.nonzero(close)
    if not len(full):
        return r, c
    part = np.argpartition(s[full], s.shape[1] - keep, 1)[:, -keep:]
    return np.concatenate([r, np.repeat(full, keep)]), np.concatenate([c, part.ravel()])


def best_per_query(q: np.ndarray, cos: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Index of the keep best (greatest cosine, then least id) of every q, sorted by q."""
    order = np.lexsort((ids, -cos, q))
    s = q[order]
    start = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    rank = np.arange(len(s)) - np.maximum.accumulate(np.where(start, np.arange(len(s)), 0)) if len(s) else s
    return order[rank < keep]


def search_bucket(b: Bucket, keep: int, least: float, each_cell=None, ids_a_class: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, cosine, id): for every class that has probes here its keep best among the cells gone
    through; of equal vectors ids_a_class, else keep ids count. each_cell(members) returns what
    also sees the cell's products, as (queries, s)."""
    lc, li = b.least_ids(ids_a_class or keep)
    order = np.argsort(b.probes[1], kind="stable")
    pq, pc = b.probes[0][order], b.probes[1][order]
    home = np.flatnonzero(b.cell >= 0)
    home = home[np.argsort(b.cell[home], kind="stable")]
    qs: list[np.ndarray] = []
    cs: list[np.ndarray] = []
    ds: list[np.ndarray] = []
    of = b.cell[home]
    for cell in np.unique(pc):
        q = pq[np.searchsorted(pc, cell) : np.searchsorted(pc, cell, "right")]
        m = home[np.searchsorted(of, cell) : np.searchsorted(of, cell, "right")]
        if not len(m):
            continue
        seen = each_cell(m) if each_cell else None
        rows = max(1, min(ROWS, (1 << 23) // len(m)))
        for at in range(0, len(q), rows):
            part = q[at : at + rows]
            s = b.u[part] @ b.u[m].T
            r, c = best_of(s, keep, least)
            qs.append(part[r])
            cs.append(m[c])
            ds.append(np.round(s[r, c].astype(np.float64), 6))
            if seen:
                seen(part, s)
    if not qs:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    q, c, d = np.concatenate(qs), np.concatenate(cs), np.concatenate(ds)
    lo, hi = np.searchsorted(lc, c), np.searchsorted(lc, c, "right")
    n = hi - lo
    q, d = np.repeat(q, n), np.repeat(d, n)
    ids = li[np.repeat(lo, n) + ragged(n)]
    best = best_per_query(q, d, ids, keep)
    return q[best], d[best], ids[best]


def similar_vectors(docs: DataFrame, k: int = 5, least: float = LEAST_COSINE, visit: int | None = None, id_col: str = "id", embedding_col: str = "embedding") -> DataFrame:
    """(id, neighbour, cosine, rank): for every usable vector the k most similar others.

    Cosines (of 16-bit components) are rounded to six decimals; ties go to the less id; neighbours below ``least``
    are left out. The candidates come from the multi-index (recall: README). Null vectors, vectors
    of another length, with entries null or not finite, and zero vectors neither ask nor answer; an
    empty table gives no rows; equal vectors are neighbours with cosine 1; other columns are ignored.
    """
    docs = docs.select(docs[id_col].cast("long").alias("id"), docs[embedding_col].alias("embedding")).where(F.col("id").isNotNull())
    index = build_index(docs)
    if index is None:
        return docs.sparkSession.createDataFrame([], "id long, neighbour long, cosine double, rank int")
    keep = k + 1
    visit = visit or visit_for(int(index.size.sum()))
    shared = docs.sparkSession.sparkContext.broadcast(astuple(index))

    def search(first: bool):
        def task(t: pa.Table) -> pa.Table:
            """The neighbours that the queries here have in the bucket; in the first turn also its members."""
            b = Bucket.read(t, MultiIndex(*shared.value))
            q, cos, ids = search_bucket(b, keep, least)
            start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
            near = pa.StructArray.from_arrays([pa.array(-cos), pa.array(ids)], names=["d", "id"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(q)).astype(np.int32)), near)
            own = b.members if first and t.column("part")[0].as_py() == 0 else b.members[:, :0]
            h = np.concatenate([b.h[q[start]], b.h[own[0]]]).view(np.int64)
            none = pa.nulls(len(own[1]), lists.type)
            return pa.table({"h": pa.array(h), "id": pa.concat_arrays([pa.nulls(len(start), pa.int64()), pa.array(own[1])]), "near": pa.concat_arrays([lists, none])})

        return task

    turns = turns_for(index, visit)
    turn = lambda n: routed(docs, index, visit, turn=n, turns=turns).groupBy("bucket", "part").applyInArrow(search(n == 0), "h long, id long, near array<struct<d:double,id:long>>")
    found = reduce(DataFrame.unionByName, [cut_and_released(turn(n)) for n in range(turns)])
    best = found.where("id is null").groupBy("h").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, keep).alias("near"))
    own = found.where("id is not null").select("h", "id")
    lists = own.join(best, "h").select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return lists.select("id", F.posexplode("near").alias("rank", "n")).select("id", F.col("n.id").alias("neighbour"), (-F.col("n.d")).alias("cosine"), (F.col("rank") + 1).alias("rank"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_vectors(table(spark, sf_dir, "docs"))
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
