"""Candidate pairs of alike records, and their exact check.

Two records are *alike* when their contents (each of at least eight words) share at least 0.80 of
the longer one's words, repeats counted, or when the cosine of their usable embeddings, rounded to
six decimals, is at least 0.98. One pass over the records packs signatures into blocks, one task
per bucket turns equal signatures into candidate pairs that survive a sketch test which no alike
pair fails, and the pairs are then checked on the words and vectors themselves.

Contents: a size-aware heavy-light join. Words are put in one global order, rarest first. If two
contents share the share, their first two common words lie in both *prefixes* (the rarest
``n - ceil(0.8 n) + 2`` words). A small set enumerates the two-word subsets of its prefix; a large
one, whose subsets would cost more than reading inverted lists, is matched by scanning the lists of
its prefix words. The boundary comes from the corpus's word counts. No alike pair is missed.

Embeddings: the signs against fixed orthogonal directions make a set; ``tables`` subsets of ``bits``
signs are enumerated per vector. Their number keeps the chance of missing a pair at the threshold
below one in a thousand, and it falls steeply above it.

Records with equal words, or equal vectors, are one class: a block keeps one of them, so a group of
copies of any size adds one signature set per block. A signature shared by more than ``HOT`` classes
yields a star first and is gone through again, against what is decided by then. Where more pairs of
one signature must be compared than one task should (``TILE`` times ``TILE``), its classes are cut
into parts, and each two parts are one task of a further stage.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DIM, WordHash, batches, buckets_for, cut, mix, occurrence_numbers, runs, unit, vectors, word_rows, words

LEAST_WORDS = 8
SHARE = 0.80
COSINE = 0.98
#: Cells of the word counter: a fixed size, whatever the vocabulary.
COUNTER = 1 << 18
HOT = 4096
#: Pairs with earlier classes that a class yields in one signature; more wait for the second look.
LINKS = 64
#: Pairs compared at once; classes of a signature from which on its pairs are shared out in tiles of as many.
CHUNK, TILE = 1 << 20, 8192
TEXT, LIST, VEC, COPY, LINK = 0, 1, 2, 3, 4
TEXT_ROW = np.dtype([("id", "<i8"), ("label", "<i8"), ("h", "<u8"), ("n", "<i4"), ("s", "<u8", (2,))])
VEC_ROW = np.dtype([("id", "<i8"), ("label", "<i8"), ("h", "<u8"), ("s", "<u8", (8,))])
SKETCH_BITS = 512
BLOCK = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("rows", pa.binary()), ("sigs", pa.binary()), ("idx", pa.binary())])
BLOCK_SQL = "kind int, bucket int, rows binary, sigs binary, idx binary"
PAIRS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
PAIRS_SQL = "kind int, a long, b long"
#: Pairs, or with a run: a part of its classes that waits for its tiles.
FOUND = pa.schema([*PAIRS, ("run", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("rows", pa.binary())])
FOUND_SQL = PAIRS_SQL + ", run long, part int, parts int, rows binary"


def needed(n: np.ndarray) -> np.ndarray:
    """Words two contents must have in common if the longer one has n: ceil(0.8 n)."""
    return (8 * n + 9) // 10


def corpus_counts(docs: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(records, word counts in COUNTER hashed cells, records by number of words up to 65,535)."""
    slices = 16

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, cells, sizes, n = WordHash(), np.zeros(COUNTER, np.int64), np.zeros(1 << 16, np.int64), 0
        for t in batches(rows):
            h, off = word_rows(t.column("content").to_pylist(), seen)
            cells += np.bincount((h & np.uint64(COUNTER - 1)).astype(np.int64), minlength=COUNTER)
            sizes += np.bincount(np.minimum(np.diff(off), (1 << 16) - 1), minlength=1 << 16)
            n += t.num_rows
        if n:
            parts = [c.tobytes() for c in np.split(cells, slices)] + [sizes.tobytes(), np.array([n]).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(range(slices + 2), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "part"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in t.column("part").to_pylist())
        return pa.table({"slice": t.column("slice").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    schema = "slice int, part binary"
    got = docs.select("content").mapInArrow(count, schema).groupBy("slice").applyInArrow(add, schema).collect()
    part = {r["slice"]: np.frombuffer(r["part"], np.int64) for r in got}
    if not part:
        return 0, np.zeros(COUNTER, np.int64), np.zeros(1 << 16, np.int64)
    return int(part[slices + 1][0]), np.concatenate([part[i] for i in range(slices)]), part[slices]


def large_from(cells: np.ndarray) -> int:
    """Words from which a set is large: where scanning its lists costs less than its subsets.

    A prefix of p words has p(p-1)/2 subsets, and its lists hold p times the mean count of the
    rarest fifth of all words (by occurrences), which is what prefixes consist of.
    """
    c = np.sort(cells[cells > 0]).astype(np.float64)
    if not len(c):
        return 1 << 30
    fifth = c[np.cumsum(c) <= max(0.2 * c.sum(), c[0])]
    p = 2 * float((fifth * fifth).sum() / fifth.sum()) + 1
    return max(LEAST_WORDS, int(5 * (p - 2)))


def directions(count: int, seed: int) -> np.ndarray:
    """count directions in DIM dimensions, orthogonal within each run of DIM of them."""
    rng = np.random.default_rng(seed)
    sets = [np.linalg.qr(rng.standard_normal((DIM, DIM)))[0] for _ in range(-(-count // DIM))]
    return np.concatenate(sets, 1)[:, :count].astype(np.float32)


def tables_for(n: int) -> tuple[int, int]:
    """(signs per table, tables): a pair of cosine COSINE is missed with a chance below 0.001."""
    bits = min(30, max(12, math.ceil(math.log2(max(n, 2))) + 6))
    hit = (1 - math.acos(COSINE) / math.pi) ** bits
    return bits, math.ceil(math.log(1e-3) / math.log(1 - hit))


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after another."""
    end = np.cumsum(counts)
    return np.arange(end[-1] if len(end) else 0) - np.repeat(end - counts, counts)


def text_sets(t: pa.Table, seen: WordHash):
    """Per content of LEAST_WORDS words or more: its table row, n; flat (row, word hash, token)."""
    h, off = word_rows(t.column("content").to_pylist(), seen)
    n = np.diff(off)
    keep = np.flatnonzero(n >= LEAST_WORDS)
    flat = np.repeat(n >= LEAST_WORDS, n)
    h, n = h[flat], n[keep]
    row = np.repeat(np.arange(len(keep)), n)
    token = mix(h + occurrence_numbers(row, h).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return keep, n, row, h, token


def text_rows(t: pa.Table, keep, n, row, token) -> np.ndarray:
    out = np.zeros(len(keep), TEXT_ROW)
    if not len(keep):
        return out
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    out["id"] = t.column("id").to_numpy()[keep]
    out["label"] = t.column("label").to_numpy()[keep]
    out["n"] = n
    out["h"] = mix(np.add.reduceat(mix(token ^ np.uint64(0x5851F42D4C957F2D)), start) + n.astype(np.uint64))
    bit = np.uint64(1) << (token & np.uint64(63))
    high = (token >> np.uint64(6)) & np.uint64(1) > 0
    out["s"][:, 0] = np.bitwise_xor.reduceat(np.where(high, np.uint64(0), bit), start)
    out["s"][:, 1] = np.bitwise_xor.reduceat(np.where(high, bit, np.uint64(0)), start)
    return out


def first_of_class(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the row of least id for each distinct h; for each row that index)."""
    order = np.lexsort((rows["id"], rows["h"]))
    h = rows["h"][order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.empty(len(h), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else 0
    return np.sort(order[new]), first


def bucket_of(sig: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each signature; in 16 bits, which sort fastest, where they suffice."""
    return ((sig >> np.uint64(33)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)


class Packer:
    """Collects one block's signatures and writes them by bucket, in their order if in_order."""

    def __init__(self, kind: int, buckets: int, in_order: bool = False):
        self.kind, self.buckets, self.in_order = kind, buckets, in_order
        self.idx: list[np.ndarray] = []
        self.sig: list[np.ndarray] = []

    def add(self, idx: np.ndarray, sig: np.ndarray) -> None:
        self.idx.append(idx.astype(np.uint16))
        self.sig.append(sig)

    def pack(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not self.sig:
            return
        sig, idx = np.concatenate(self.sig), np.concatenate(self.idx)
        self.sig, self.idx = [], []
        # Sorted once: the work follows the signatures, not the number of buckets.
        for b, part in runs(bucket_of(sig, self.buckets)):
            s = (sig[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            if self.in_order:
                order = np.argsort(s, kind="stable")
                s, part = s[order], part[order]
            used, local = np.unique(idx[part], return_inverse=True)
            yield block(self.kind, b, rows[used], s, local.astype(np.uint16))


def block(kind: int, bucket: int, rows: np.ndarray, sigs: np.ndarray, idx: np.ndarray) -> pa.RecordBatch:
    one = lambda x: pa.array([x.tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), one(rows), one(sigs), one(idx)], schema=BLOCK)


def copies(rows: np.ndarray, kind: int, bucket: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The classes of a block: (least id, other id) links, and (class, least id) for their bucket."""
    keep, first = first_of_class(rows)
    other = first != np.arange(len(rows))
    if other.any():
        yield block(LINK, bucket % buckets, np.stack([rows["id"][first[other]], rows["id"][other]]), np.array([kind], np.int64), np.zeros(0, np.uint16))
    h = rows["h"][keep]
    to = (h % np.uint64(buckets)).astype(np.int64)
    for b, at in runs(to):
        yield block(COPY, b, np.stack([h[at].view(np.int64), rows["id"][keep][at]]), np.array([kind], np.int64), np.zeros(0, np.uint16))


def subset_signatures(rows: np.ndarray, n, row, h, token, cells: np.ndarray, large: int, small: Packer, lists: Packer) -> None:
    """Two-word subsets of the prefixes of small sets; prefix words for the inverted lists."""
    order = np.lexsort((token, cells[(h & np.uint64(COUNTER - 1)).astype(np.int64)], row))
    token = token[order]
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    prefix = n - needed(n) + 2
    listed = np.flatnonzero(n >= needed(np.int64(large)))
    if len(listed):
        p = prefix[listed] - 1
        at = np.repeat(start[listed], p) + ragged(p)
        lists.add(np.repeat(listed, p), mix(token[at] ^ np.uint64(0x1234567)))
    of = np.where(n < large, prefix, 0)
    for p in np.unique(of[of > 1]):
        r = np.flatnonzero(of == p)
        m = token[start[r][:, None] + np.arange(p)]
        i, j = np.triu_indices(int(p), 1)
        lo, hi = np.minimum(m[:, i], m[:, j]), np.maximum(m[:, i], m[:, j])
        small.add(np.repeat(r, len(i)), mix(lo * np.uint64(0xD6E8FEB86659FD93) + hi).ravel())


def vector_signatures(rows: np.ndarray, u: np.ndarray, first: np.ndarray, bits: int, tables: int, packer: Packer) -> None:
    """Fills the sketches of rows; for the rows in first adds a signature for each table."""
    dirs = directions(SKETCH_BITS + bits * tables, 20250)
    x = u.astype(np.float32)
    rows["s"] = np.packbits(x @ dirs[:, :SKETCH_BITS] > 0, axis=1).view(np.uint64)
    weight = (np.uint64(1) << np.arange(bits, dtype=np.uint64))[None, :]
    x = x[first]
    for t in range(tables):
        on = x @ dirs[:, SKETCH_BITS + t * bits : SKETCH_BITS + (t + 1) * bits] > 0
        packer.add(first, mix(mix((on * weight).sum(1, dtype=np.uint64)) + np.uint64((t + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))


def hamming_limit() -> int:
    """Sketch bits in which a pair at the threshold may differ: its mean plus five deviations."""
    p = math.acos(COSINE) / math.pi
    return int(SKETCH_BITS * p + 5 * math.sqrt(SKETCH_BITS * p * (1 - p)))


def like_sketch(kind: int, rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows (x, y) can be alike by their sizes and sketches."""
    s = rows["s"]
    if kind == VEC:
        return np.bitwise_count(s[x] ^ s[y]).sum(1) <= hamming_limit()
    n, m = rows["n"][x], rows["n"][y]
    t = needed(np.maximum(n, m))
    out = np.minimum(n, m) >= t
    at = np.flatnonzero(out)
    far = np.bitwise_count(s[x[at], 0] ^ s[y[at], 0]).astype(np.int32) + np.bitwise_count(s[x[at], 1] ^ s[y[at], 1])
    out[at] = far <= (n + m - 2 * t)[at]
    return out


def run_partners(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (k, j) with first[k] <= j < last[k], in chunks of about CHUNK."""
    count = np.maximum(last - first, 0)
    at = 0
    while at < len(count):
        sums = np.cumsum(count[at : at + CHUNK])
        to = at + max(1, int(np.searchsorted(sums, CHUNK, side="right")))
        c = count[at:to]
        if c.any():
            yield np.repeat(np.arange(at, to), c), np.repeat(first[at:to], c) + ragged(c)
        at = to


def bucket_pairs(kind: int, rows: np.ndarray, sig: np.ndarray, idx: np.ndarray, large: int, again: str | None) -> tuple[np.ndarray, bool, list[tuple[int, np.ndarray]]]:
    """(distinct candidate pairs (less id, greater id), whether a hot signature waits for a second look,
    (signature, rows) of those left to tiles).

    again None: all pairs of a signature's classes, or of a hot one the star around its least id.
    again "labels": hot signatures only, pairs whose labels differ. again "kept": hot signatures
    only, pairs of which one has an odd label. again "new": the same for all signatures.
    """
    empty = np.zeros((2, 0), np.int64)
    order = np.argsort(sig, kind="stable")  # merges what comes in ordered runs
    s, k = sig[order], idx[order]
    same = np.concatenate([[False], s[1:] == s[:-1]])
    in_run = same.copy()
    in_run[:-1] |= same[1:]
    s, k = s[in_run], k[in_run]
    if not len(s):
        return empty, False, []
    ids, hs = rows["id"], rows["h"]
    order = np.lexsort((ids[k], hs[k], s))  # one entry a class, the least id
    s, k = s[order], k[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (hs[k][1:] != hs[k][:-1])
    s, k = s[new], k[new]
    hot_seen = False
    label = rows["label"] & 1 if again in ("kept", "new") else rows["label"]
    order = np.lexsort((label[k], s)) if again else np.lexsort((ids[k], s))
    s, k = s[order], k[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    length = np.diff(np.append(start, len(s)))
    end = np.repeat(start + length, length)
    hot = np.repeat(length > (HOT if again is None else min(HOT, LINKS)), length) & (kind != LIST) | (again == "new")
    # A signature with too many pairs to compare leaves them to tiles.
    if again == "labels":
        key = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (label[k][1:] != label[k][:-1])]))
        size = np.diff(np.append(key, len(s)))
        same_label = np.add.reduceat(size * size, np.searchsorted(key, start))
        work = np.where(hot[start], (length * length - same_label) // 2, 0)
    elif again:
        odd = np.add.reduceat((label[k] == 1).astype(np.int64), start)
        work = np.where(hot[start], odd * length, 0)
    else:
        work = np.where(kind == LIST, length * length // 2, 0)
    heavy = np.flatnonzero(work > TILE * TILE)
    tiles = [(int(s[start[r]]), rows[k[start[r] : start[r] + length[r]]]) for r in heavy]
    tiled = np.repeat(work > TILE * TILE, length)
    links = np.zeros(len(s), np.int64)
    here = np.arange(len(s))
    if again is None:
        hot_seen = bool(hot.any())
        last = np.where(tiled | (hot & (here != np.repeat(start, length))), here + 1, end)
        jobs = run_partners(here + 1, last)
    elif again == "labels":
        jobs = run_partners(np.repeat(key + size, size), np.where(hot & ~tiled, end, 0))
    else:  # kept: those with an odd label come last in a run
        begin = np.repeat(start, length)
        jobs = run_partners(begin, np.where(hot & ~tiled & (label[k] == 1), here, 0))
    found: list[np.ndarray] = []
    for i, j in jobs:
        x, y = k[i], k[j]
        ok = like_sketch(kind, rows, x, y)
        if kind == LIST:
            ok &= (rows["n"][x] >= large) | (rows["n"][y] >= large)
        if again is None and kind != LIST and ok.any():
            at = np.flatnonzero(ok)
            late = np.argsort(j[at], kind="stable")
            to = j[at][late]
            rank = np.arange(len(to)) - np.searchsorted(to, to) + links[to]
            np.add.at(links, to, 1)
            if (rank >= LINKS).any():
                hot_seen = True
                ok[at[late[rank >= LINKS]]] = False
        if ok.any():
            p, q = ids[x[ok]], ids[y[ok]]
            found.append(np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)]), axis=1))
    return (np.unique(np.concatenate(found, 1), axis=1) if found else empty), hot_seen, tiles


def tile_pairs(large: int, again: str | None):
    """The candidate pairs between two parts of a signature's classes, or within one."""

    def task(t: pa.Table) -> pa.Table:
        kind, i, j = (t.column(c)[0].as_py() for c in ("kind", "i", "j"))
        part = {p: np.frombuffer(x, VEC_ROW if kind == VEC else TEXT_ROW) for p, x in zip(t.column("part").to_pylist(), t.column("rows").to_pylist())}
        rows = part[i] if i == j else np.concatenate([part[i], part[j]])
        n = len(part[i])
        here = np.arange(n)
        found = [np.zeros((2, 0), np.int64)]
        for x, y in run_partners(here + 1 if i == j else np.full(n, n), np.full(n, len(rows))):
            ok = like_sketch(kind, rows, x, y)
            if kind == LIST:
                ok &= (rows["n"][x] >= large) | (rows["n"][y] >= large)
            if again == "labels":
                ok &= rows["label"][x] != rows["label"][y]
            elif again:
                ok &= (rows["label"][x] | rows["label"][y]) & 1 == 1
            p, q = rows["id"][x[ok]], rows["id"][y[ok]]
            found.append(np.stack([np.minimum(p, q), np.maximum(p, q)]))
        a, b = np.concatenate(found, 1)
        return pa.table({"kind": pa.array(np.full(len(a), VEC if kind == VEC else TEXT), pa.int32()), "a": pa.array(a), "b": pa.array(b)}, schema=PAIRS)

    return task


def pairs_of_bucket(large: int, again: str | None):
    def task(t: pa.Table) -> pa.Table:
        kind = t.column("kind")[0].as_py()
        rows, sigs, idxs = (t.column(c).to_pylist() for c in ("rows", "sigs", "idx"))
        kinds: list[np.ndarray] = []
        pairs: list[np.ndarray] = []
        tiles: list[tuple[int, np.ndarray]] = []
        if kind in (LINK, COPY):
            two = [np.frombuffer(x, np.int64).reshape(2, -1) for x in rows]
            of = np.concatenate([np.full(x.shape[1], np.frombuffer(s, np.int64)[0]) for x, s in zip(two, sigs)])
            a, b = np.concatenate(two, 1)
            if kind == COPY:
                order = np.lexsort((b, a, of))
                a, b, of = a[order], b[order], of[order]
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (of[1:] != of[:-1])])
                a = b[np.flatnonzero(new)][np.cumsum(new) - 1]
                a, b, of = a[~new], b[~new], of[~new]
            kinds.append(of + 10)
            pairs.append(np.stack([a, b]))
        else:
            kind_rows = [np.frombuffer(x, VEC_ROW if kind == VEC else TEXT_ROW) for x in rows]
            base = np.cumsum([0] + [len(x) for x in kind_rows[:-1]])
            idx = np.concatenate([np.frombuffer(x, np.uint16).astype(np.int64) + o for x, o in zip(idxs, base)])
            sig = np.concatenate([np.frombuffer(x, np.uint32) for x in sigs])
            got, hot, tiles = bucket_pairs(kind, np.concatenate(kind_rows), sig, idx, large, again)
            kinds.append(np.full(got.shape[1], VEC if kind == VEC else TEXT))
            pairs.append(got)
            if hot:
                kinds.append(np.array([-1]))
                pairs.append(np.array([[0], [0]]))
        a, b = np.concatenate(pairs, 1)
        out = pa.table({"kind": pa.array(np.concatenate(kinds), pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), **{f.name: pa.nulls(len(a), f.type) for f in FOUND if f.name not in PAIRS.names}}, schema=FOUND)
        for signature, members in tiles:
            parts = -(-len(members) // TILE)
            run = [(t.column("bucket")[0].as_py() << 32) + signature] * parts
            rows = [members[p * TILE : (p + 1) * TILE].tobytes() for p in range(parts)]
            out = pa.concat_tables([out, pa.table({"kind": [kind] * parts, "a": [None] * parts, "b": [None] * parts, "run": run, "part": range(parts), "parts": [parts] * parts, "rows": rows}, schema=FOUND)])
        return out

    return task


def candidates(docs: DataFrame, counts, labels: DataFrame | None = None, again: str | None = None) -> DataFrame:
    """Checkpointed (kind, a, b), distinct: TEXT and VEC candidates between least ids of classes,
    10 + kind for links of copies (less id, greater id), -1 where a hot signature was met."""
    return nominated(signature_blocks(docs, counts, labels, again), large_from(counts[1]), again)


def nominated(blocks: DataFrame, large: int, again: str | None) -> DataFrame:
    """The candidates among the signatures of the blocks, checkpointed."""
    found = cut(blocks.groupBy("kind", "bucket").applyInArrow(pairs_of_bucket(large, again), FOUND_SQL))
    pairs = found.where("run is null").select("kind", "a", "b")
    left = found.where("run is not null").select("kind", "run", "part", "rows", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    if left.limit(1).count():
        tiles = left.select("kind", "run", "part", "rows", F.least("p", "part").alias("i"), F.greatest("p", "part").alias("j"))
        pairs = pairs.unionByName(tiles.groupBy("kind", "run", "i", "j").applyInArrow(tile_pairs(large, again), PAIRS_SQL))
    return cut(pairs.distinct())


def signature_blocks(docs: DataFrame, counts, labels: DataFrame | None = None, again: str | None = None, buckets: int = 0, in_order: bool = False) -> DataFrame:
    """Packed signatures of the docs by kind and bucket, in each block in order if in_order. buckets: their
    number, if it must not follow the table."""
    total, cells, sizes = counts
    large = large_from(cells)
    bits, tables = tables_for(total)
    counted = np.arange(len(sizes))
    prefix = np.where(counted >= LEAST_WORDS, counted - needed(counted) + 2, 0)
    entries = int((sizes * np.where(counted < large, prefix * (prefix - 1) // 2, 0)).sum())
    listed = int((sizes * np.where(counted >= needed(np.int64(large)), prefix, 0)).sum())
    nt, nl, nv = buckets_for(entries, 4_000_000), buckets_for(listed, 2_000_000, 1), buckets_for(tables * total, 2_000_000)
    if buckets:
        nt = nl = nv = buckets
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(np.minimum(cells, (1 << 31) - 1).astype(np.int32))
    source = docs
    if labels is None and "label" not in docs.columns:
        source = source.withColumn("label", F.lit(0).cast("long"))
    elif labels is not None:
        source = source.join(labels.select(F.col("node").alias("id"), F.col("label").cast("long")), "id", "left").withColumn("label", F.coalesce("label", "id"))

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHash()
        for number, t in enumerate(batches(rows)):
            keep, n, row, h, token = text_sets(t, seen)
            out = text_rows(t, keep, n, row, token)
            if len(out):
                if again in (None, "new"):
                    yield from copies(out, TEXT, number, nv)
                mine, _ = first_of_class(out)
                pick = np.zeros(len(out), bool)
                pick[mine] = True
                flat = np.repeat(pick, n)
                rank = np.cumsum(pick) - 1
                small, lists = Packer(TEXT, nt, in_order), Packer(LIST, nl, in_order)
                subset_signatures(out[pick], n[pick], rank[row[flat]], h[flat], token[flat], shared.value, large, small, lists)
                yield from small.pack(out[pick])
                yield from lists.pack(out[pick])
            at, x = vectors(t.column("embedding"))
            if len(at):
                u = unit(x)
                v = np.zeros(len(at), VEC_ROW)
                v["id"], v["label"] = t.column("id").to_numpy()[at], t.column("label").to_numpy()[at]
                place = mix(np.arange(1, DIM + 1, dtype=np.uint64))
                v["h"] = mix(mix(x.view(np.uint32).astype(np.uint64) + place).sum(1))
                if again in (None, "new"):
                    yield from copies(v, VEC, number, nv)
                packer = Packer(VEC, nv, in_order)
                vector_signatures(v, u, first_of_class(v)[0], bits, tables, packer)
                yield from packer.pack(v)

    return source.mapInArrow(emit, BLOCK_SQL)


def share(a: str | None, b: str | None) -> bool:
    """Exactly: do the contents share at least SHARE of the longer one's words, both long enough?"""
    x, y = words(a), words(b)
    longer = max(len(x), len(y))
    if min(len(x), len(y)) < LEAST_WORDS or 5 * min(len(x), len(y)) < 4 * longer:
        return False
    return 5 * sum((Counter(x) & Counter(y)).values()) >= 4 * longer


def checked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(kind, a, b) of the candidate pairs that are alike by what their kind compares."""

    def texts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in rows:
            ok = pa.array(map(share, t.column("x").to_pylist(), t.column("y").to_pylist()), pa.bool_())
            yield t.filter(ok).select(["kind", "a", "b"])

    def cosines(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in rows:
            (i, x), (j, y) = vectors(t.column("x")), vectors(t.column("y"))
            assert len(i) == len(j) == t.num_rows
            if t.num_rows:
                c = np.round((unit(x) * unit(y)).sum(1), 6)
                yield t.filter(pa.array(c >= COSINE)).select(["kind", "a", "b"])

    out = None
    for kind, column, test in ((TEXT, "content", texts), (VEC, "embedding", cosines)):
        side = docs.select("id", F.col(column).alias("p"))
        both = (
            pairs.where(F.col("kind") == kind)
            .join(side.select(F.col("id").alias("a"), F.col("p").alias("x")), "a")
            .join(side.select(F.col("id").alias("b"), F.col("p").alias("y")), "b")
            .select("kind", "a", "b", "x", "y")
        )
        got = both.mapInArrow(test, PAIRS_SQL)
        out = got if out is None else out.unionByName(got)
    return out


def plain(docs: DataFrame, id_col: str, content_col: str, embedding_col: str, *more: Column) -> DataFrame:
    """The three columns under fixed names, and more; records without an id take no part."""
    return docs.select(docs[id_col].cast("long").alias("id"), docs[content_col].alias("content"), docs[embedding_col].alias("embedding"), *more).where(F.col("id").isNotNull())

