"""Problem 7: held-out test items that leaked into documents, by template windows.

Words of an item are *fixed* when many items use them (counted once over all items), else they fill a
*slot*. A text becomes
canonical by keeping its fixed words and putting a typed placeholder (number, unit, other word: a
name or content word; capitals are no help in files all in capitals) in each slot. Windows of
``WINDOW`` canonical words with enough fixed ones are joined by hash between items and documents,
so a damaged filler does not lose a window. Then the slots are compared: a window counts when at
least half of its slots hold the item's own words, which a re-parameterised question does not.
Documents and items with such windows are aligned word by word, and a passage of at least
``PASSAGE`` consecutive item words with few of them missing, added or damaged is a leak.

Damage can break every such window. So runs of ``SHORT`` equal words are joined as well: a passage
with at most ``DAMAGE`` errors keeps ``SHORT_RUNS`` of them within ``SHORT_SPAN`` words, and places
with as many are aligned when enough of the item's words are there and half of the slots agree.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alike import ragged
from .common import WORD, batches, mix, table

WINDOW = 5
FIXED_IN_WINDOW = 2
#: Items that use a word, from which on it is fixed: so many, and such a share of all items.
FIXED_FROM, FIXED_SHARE = 3, 1 / 80
PASSAGE = 15
#: Errors a passage may hold, as a share of its words.
DAMAGE = 0.21
#: Items sent to the tasks at once; more are gone through in blocks.
ITEMS = 50_000
#: A passage of 30 words or more has a part of PASSAGE to 29 words with no greater share of errors. Of
#: n words with e errors at least n - e - 2 * (e + 1) runs of three stay whole: four or more, up to e
#: words farther apart than in the item.
SHORT, SHORT_RUNS, LONGEST_PART = 3, 4, 2 * PASSAGE - 1
#: Score of a match that keeps a single word at the end of a passage, beyond up to three errors.
LOOSE = 12
SHORT_SPAN = LONGEST_PART + int(DAMAGE * LONGEST_PART)
#: Words that a piece of a torn passage must match; document words its pieces may lie apart.
LEAST_PIECE, NEAR_PIECE = 4, 150
#: Words around the matching windows that the alignment sees.
AROUND = 24
#: Words for units of measure, each of which becomes one placeholder.
UNITS = frozenset("second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons dollar dollars cent cents euro euros percent degree degrees".split())
#: What interrupts a passage without counting: timings, cue numbers, headers, tags, sounds, speakers.
NOISE = re.compile(
    r"^[^\n]*\d{1,2}:\d{2}[.,:]\d{2,3}[^\n]*$|^[ \t﻿]*\d+[ \t]*$|^WEBVTT[^\n]*$|<[^<>\n]{1,80}>|\{[^{}\n]{1,80}\}|\[[^\[\]]{1,80}\]|\([^()]{1,80}\)"
    r"|^[ \t]*(?:-[ \t]*)?(?!(?:question|answer)\b)[A-ZÀ-ÞА-Я][\w.'#-]*(?:[ ][A-ZÀ-ÞА-Я#][\w.'#]*){0,2}[ ]?:(?=[ \t\n])",
    re.M,
)


class Coded(dict):
    """Word -> 64-bit hash whose two lowest bits say: 1 number, 2 unit, 0 other."""

    def __missing__(self, w: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) & ~3
        h = self[w] = h | (1 if w.isdigit() else 2 if w in UNITS else 0)
        return h


def spoken(text: str | None) -> list[str]:
    """The words of a subtitle text without what interrupts them; null has none."""
    if not text:
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "&" in text:
        text = html.unescape(text)
    # Capitals of labels are needed, those of words are not.
    return WORD.findall(NOISE.sub(" ", text).lower())


def canonical(h: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(canonical words, which of them are fixed). fixed: sorted hashes."""
    at = np.searchsorted(fixed, h)
    is_fixed = fixed[np.minimum(at, len(fixed) - 1)] == h if len(fixed) else np.zeros(len(h), bool)
    return np.where(is_fixed, h, (h & np.uint64(3)) + np.uint64(7)), is_fixed


def windows(c: np.ndarray, is_fixed: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows inside a text that have enough fixed words and a slot."""
    n = len(c) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = np.zeros(n, np.uint64)
    for d in range(WINDOW):
        w = mix(w * np.uint64(31) + c[d : d + n])
    count = np.concatenate([[0], np.cumsum(is_fixed)])
    inside = np.ones(n, bool)
    for d in range(1, WINDOW):
        cut = off[1:-1] - d
        inside[cut[(cut >= 0) & (cut < n)]] = False
    fixed = count[WINDOW:] - count[:-WINDOW]
    start = np.flatnonzero(inside & (fixed >= FIXED_IN_WINDOW) & (fixed < WINDOW))
    return start, w[start]


def short_runs(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of all runs of SHORT words inside a text, words as they are."""
    n = len(h) - SHORT + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = np.zeros(n, np.uint64)
    for d in range(SHORT):
        w = mix(w * np.uint64(31) + h[d : d + n])
    start = np.arange(n)
    start = start[np.searchsorted(off, start, "right") == np.searchsorted(off, start + SHORT - 1, "right")]
    return start, w[start]


def item_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def fixed_from(items: int) -> int:
    return max(FIXED_FROM, -int(-items * FIXED_SHARE // 1))


def fixed_words(items: DataFrame, count: int) -> np.ndarray:
    """Sorted hashes of the words that at least fixed_from(count) items use; items: (i, t), different ones.

    There are no more than 1 / FIXED_SHARE times the words of a mean item: a bound that does not grow.
    """

    def use(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = Coded()
        for t in batches(rows):
            n = Counter(h for x in t.column("t").to_pylist() for h in {coded[w] for w in item_words(x)})
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(n), np.uint64).view(np.int64)), pa.array(list(n.values()), pa.int64())], names=["h", "n"])

    got = items.select("t").mapInArrow(use, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= fixed_from(count)).select("h").collect()
    return np.sort(np.array([r["h"] for r in got], np.int64).view(np.uint64))


class Items:
    """The items of one block: their words, windows sorted by hash, and the fixed words of all items."""

    def __init__(self, ids: list[int], texts: list[str | None], fixed: np.ndarray):
        coded = Coded()
        self.ids = ids
        words = [[coded[w] for w in item_words(t)] for t in texts]
        self.fixed = fixed
        self.flat = np.array([h for w in words for h in w], np.uint64)
        self.off = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        c, f = canonical(self.flat, self.fixed)
        self.slot = ~f
        start, key = windows(c, f, self.off)
        order = np.argsort(key, kind="stable")
        self.key, self.start = key[order], start[order]
        self.item = np.searchsorted(self.off, self.start, "right") - 1
        start, key = short_runs(self.flat, self.off)
        order = np.argsort(key, kind="stable")
        self.short_key = key[order]
        self.short_item = np.searchsorted(self.off, start[order], "right") - 1

    def places(self, h: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first, last position) where SHORT_RUNS short runs of an item come together."""
        start, key = short_runs(h, off)
        lo = np.searchsorted(self.short_key, key)
        n = np.searchsorted(self.short_key, key, "right") - lo
        p = np.repeat(start, n)
        it = self.short_item[np.repeat(lo, n) + ragged(n)]
        order = np.lexsort((p, it))
        p, it = p[order], it[order]
        doc = np.searchsorted(off, p, "right") - 1
        m = SHORT_RUNS - 1
        if len(p) <= m:
            return
        dense = np.flatnonzero((it[m:] == it[:-m]) & (doc[m:] == doc[:-m]) & (p[m:] - p[:-m] <= SHORT_SPAN))
        if not len(dense):
            return
        new = np.concatenate([[True], (it[dense[1:]] != it[dense[:-1]]) | (doc[dense[1:]] != doc[dense[:-1]]) | (p[dense[1:]] - p[dense[:-1] + m] > AROUND)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(dense)) - 1
        for a, b in zip(dense[first], dense[last] + m):
            yield int(doc[a]), int(it[a]), int(p[a]), int(p[b])

    def may_hold(self, item: int, words: list[int]) -> bool:
        """Are enough words of some part of the item among the words?"""
        there = set(words)
        missing = np.cumsum([0] + [w not in there for w in self.words(item)])
        return any((missing[n:] - missing[:-n] <= DAMAGE * n).any() for n in range(PASSAGE, min(LONGEST_PART + 1, len(missing))))

    def slots_agree(self, item: int, pairs: list[tuple[int, int]]) -> bool:
        """Do at least half of the slots between the first and the last pair hold the item's own words?"""
        a = self.off[item]
        kept = sum(bool(self.slot[a + i]) for i, _ in pairs)
        return 2 * kept >= int(self.slot[a + pairs[0][0] : a + pairs[-1][0] + 1].sum())

    def hits(self, h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document position, item, item position) of windows whose slots agree."""
        c, f = canonical(h, self.fixed)
        start, key = windows(c, f, off)
        lo = np.searchsorted(self.key, key)
        n = np.searchsorted(self.key, key, "right") - lo
        some = np.flatnonzero(n)
        lo, n, start = lo[some], n[some], start[some]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = 1 << 16
        for a in range(0, len(n), step):
            m = n[a : a + step]
            p = np.repeat(start[a : a + step], m)
            k = np.repeat(lo[a : a + step], m) + ragged(m)
            q = self.start[k]
            same = np.zeros(len(p), np.int8)
            slots = np.zeros(len(p), np.int8)
            for d in range(WINDOW):
                s = self.slot[q + d]
                slots += s
                same += s & (h[p + d] == self.flat[q + d])
            ok = 2 * same >= slots
            out.append((p[ok], self.item[k[ok]], q[ok]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))

    def words(self, item: int) -> list[int]:
        return self.flat[self.off[item] : self.off[item + 1]].tolist()


def aligned(doc: list[int], item: list[int], match: int = 2) -> list[tuple[int, int]]:
    """Matched positions (item, document) of the best local alignment: error -3."""
    width = len(doc) + 1
    above, score = [0] * width, []
    top, at = 0, (0, 0)
    for i, w in enumerate(item, 1):
        row = [0] * width
        left = 0
        for j, d in enumerate(doc, 1):
            s = above[j - 1] + (match if d == w else -3)
            if above[j] - 3 > s:
                s = above[j] - 3
            if left - 3 > s:
                s = left - 3
            if s < 0:
                s = 0
            row[j] = left = s
            if s > top:
                top, at = s, (i, j)
        score.append(row)
        above = row
    i, j = at
    out: list[tuple[int, int]] = []
    while i > 0 and j > 0 and score[i - 1][j] > 0:
        s = score[i - 1][j]
        diagonal = score[i - 2][j - 1] if i > 1 else 0
        same = doc[j - 1] == item[i - 1]
        if s == diagonal + (match if same else -3):
            if same:
                out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif i > 1 and s == score[i - 2][j] - 3:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def longest_passage(pairs: list[tuple[int, int]], damage: float = DAMAGE) -> int:
    """Item words in the longest stretch of an alignment with at most that share of errors."""
    errors = [0]
    for (i, j), (k, m) in zip(pairs, pairs[1:]):
        errors.append(errors[-1] + max(k - i, m - j) - 1)
    best = 0
    for a in range(len(pairs)):
        for b in range(len(pairs) - 1, a, -1):
            n = pairs[b][0] - pairs[a][0] + 1
            if n <= best:
                break
            if errors[b] - errors[a] <= damage * n:
                best = n
                break
    return best


def stretches(lo: int, hi: int, item: int) -> Iterator[tuple[int, int]]:
    """Parts of a place in which one item is aligned: any passage of the item lies within one of them.

    A place is long where an item or its template is repeated; its cost stays in proportion.
    """
    width = int(item * (1 + DAMAGE)) + 2 * AROUND
    while hi - lo > 3 * width:
        yield lo, lo + 2 * width
        lo += width
    yield lo, hi


def leaked_pairs(flat: np.ndarray, off: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """(document, item, words of the passage) for the batch's documents and the block's items."""
    p, it, q = items.hits(flat, off)
    doc = np.searchsorted(off, p, "right") - 1
    order = np.lexsort((p, it, doc))
    p, it, doc = p[order], it[order], doc[order]
    begin = np.ones(min(len(p), 1), bool)
    new = np.concatenate([begin, (it[1:] != it[:-1]) | (doc[1:] != doc[:-1])])
    # A gap of more than AROUND words begins another place in the document.
    new_place = new | np.concatenate([begin, p[1:] - p[:-1] > AROUND])
    first = np.flatnonzero(new_place)
    last = np.append(first[1:], len(p))[: len(first)] - 1
    best: dict[tuple[int, int], int] = {}
    pieces: dict[tuple[int, int], list[tuple[int, list[tuple[int, int]]]]] = {}
    for a, b in zip(first, last):
        d, i = int(doc[a]), int(it[a])
        for lo, hi in stretches(max(off[d], p[a] - AROUND), min(off[d + 1], p[b] + WINDOW + AROUND), int(items.off[i + 1] - items.off[i])):
            if best.get((d, i), 0) >= PASSAGE:
                break
            words, item = flat[lo:hi].tolist(), items.words(i)
            pairs = aligned(words, item)
            n = longest_passage(pairs)
            best[d, i] = max(n, best.get((d, i), 0))
            while n < PASSAGE and len(pairs) >= LEAST_PIECE:  # what cues out of order have torn apart
                pieces.setdefault((d, i), []).append((int(lo), pairs))
                for k, m in pairs:
                    item[k], words[m] = 0, -1
                pairs = aligned(words, item)
    for at, parts in pieces.items():
        if best[at] < PASSAGE and len(parts) > 1:
            best[at] = max(best[at], *(pieced(parts, j) for j in range(len(parts))))
    for d, i, a, b in items.places(flat, off):
        if best.get((d, i), 0) >= PASSAGE:
            continue
        for lo, hi in stretches(max(off[d], a - AROUND), min(off[d + 1], b + SHORT + AROUND), int(items.off[i + 1] - items.off[i])):
            words = flat[lo:hi].tolist()
            if best.get((d, i), 0) < PASSAGE and items.may_hold(i, words):
                for match in (2, LOOSE):
                    pairs = aligned(words, items.words(i), match)
                    n = longest_passage(pairs)
                    if n >= PASSAGE and items.slots_agree(i, pairs):
                        best[d, i] = max(n, best.get((d, i), 0))
                        break
    for (d, i), n in best.items():
        if n >= PASSAGE:
            yield d, i, n


def pieced(parts: list[tuple[int, list[tuple[int, int]]]], j: int) -> int:
    """Item words in the longest stretch that piece j and those near it cover together."""
    covered = sorted({k for lo, pairs in parts if abs(lo - parts[j][0]) <= NEAR_PIECE for k, _ in pairs})
    return longest_passage([(k, k) for k in covered])


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, passage_words): the documents that hold a passage of an item, each pair once.

    Which words are fixed is counted once over all items. Items go to the tasks in blocks of about
    ITEMS, which change nothing; documents are read once a block and never shuffled. Null, empty and
    short texts hold and leak nothing; repeated documents and items count as one by their ids; empty
    tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    items = items.select(F.col(item_id_col).alias("i"), F.col(item_text_col).alias("t")).where("t is not null").distinct()
    count = items.count()
    fixed = fixed_words(items, count)
    blocks = max(1, -(-count // ITEMS))
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.hash("i", "t"), F.lit(blocks)) == b) if blocks > 1 else items
        got = part.collect()
        shared = spark.sparkContext.broadcast(([r["i"] for r in got], [r["t"] for r in got], fixed))

        def find(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, coded = None, Coded()
            for t in batches(rows, 1024):
                block = block or Items(*shared.value)
                flat: list[int] = []
                off = np.zeros(t.num_rows + 1, np.int64)
                for i, x in enumerate(t.column(1).to_pylist()):
                    flat.extend(map(coded.__getitem__, spoken(x)))
                    off[i + 1] = len(flat)
                found = list(leaked_pairs(np.array(flat, np.uint64), off, block))
                d = t.column(0).combine_chunks().take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([d, pa.array([block.ids[f[1]] for f in found], found_type), pa.array([f[2] for f in found], pa.int32())], names=["doc_id", "item_id", "passage_words"])

        found_type = pa.int64() if kinds[1] in ("bigint", "int") else pa.string()
        one = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(find, f"doc_id {kinds[0]}, item_id {'bigint' if kinds[1] in ('bigint', 'int') else 'string'}, passage_words int")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("doc_id", "item_id").agg(F.max("passage_words").alias("passage_words"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id")
