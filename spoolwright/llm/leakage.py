"""Evaluation texts that leaked into training texts, by greedy string tiling.

1. The items' runs of ``seed_words`` words (of a shorter item all its words) are hashed by a rolling polynomial: a table
   of seeds. A filter of fixed size, two bits a seed, tells what surely is no seed.
2. A document's words are read once and hashed the same way, window by window over its whole text. A document whose
   windows pass the filter leaves its word hashes and those windows; all others leave nothing.
3. Windows and seeds are joined by hash, which makes candidate pairs of document and item.
4. A document and the items it shares seeds with are tiled: running Karp-Rabin finds the longest matches of both word
   sequences that overlap no tile yet, marks them, and goes on with shorter ones down to ``min_tile`` words.
5. The tiles' share of the item's words is its coverage, which is thresholded. As tiles may lie in any order, a passage
   that was cut up and put together anew is covered like one that wasn't.

Neither items nor documents come to the driver, only the filter. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialise
from .words import plain_words

SEED_WORDS = 13
#: Equal windows of a pair that are looked at in one go.
MANY = 2_000_000
#: Bits of each half of the filter, as a power of two: 8 MB, whatever the number of seeds.
FILTER_BITS = 26
#: Items that a document is tiled with in one go.
ITEMS_AT_ONCE = 1_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def _power(of: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(of)
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), base, np.uint64)
        have[0] = 1
        have = _powers[of] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of ``size`` values (uint64), all in one pass: sums of values times falling powers, each
    brought to a common power. Arithmetic is modulo 2^64."""
    n = len(values)
    if n < size:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power("down", _INVERSE, n), out=sums[1:], dtype=np.uint64)
    return (sums[size:] - sums[:-size]) * _power("up", _BASE, n - size + 1)


def tiles(item: np.ndarray, doc: np.ndarray, minimum: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences (uint64): (start in item, start in document, length) of tiles that
    overlap neither in the item nor in the document, each the longest that is left, of at least ``minimum`` words; of
    equals the first in the item, then in the document."""
    out: list[tuple[int, int, int]] = []
    free_a, free_b = np.ones(len(item), bool), np.ones(len(doc), bool)
    size = max(minimum, 20)
    while len(item) >= minimum and len(doc) >= minimum:
        found = _matches(item, doc, free_a, free_b, size) if size <= min(len(item), len(doc)) else []
        if found and -found[0][0] > 2 * size:
            size = -found[0][0]
            continue
        while found:
            n, i, j = heapq.heappop(found)
            n = -n
            ok = free_a[i : i + n] & free_b[j : j + n]
            if ok.all():
                out.append((i, j, n))
                free_a[i : i + n] = free_b[j : j + n] = False
                continue
            # what no tile covers of it goes back in line
            edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
            for s, e in zip(edge[::2], edge[1::2]):
                if e - s >= size:
                    heapq.heappush(found, (-int(e - s), int(i + s), int(j + s)))
        if size == minimum:
            break
        size = size // 2 if size > 2 * minimum else minimum
    return out


def _windows(seq: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows that hold no tile."""
    taken = np.concatenate(([0], np.cumsum(~free)))
    at = np.flatnonzero(taken[size:] == taken[:-size])
    return at, window_hashes(seq, size)[at]


def _runs(item, doc, free_a, free_b, size) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of equal windows on a diagonal: start in the item, start in the document, number of windows. The
    item's windows are gone through in blocks with about ``MANY`` equal ones, and runs that a border cut are joined."""
    at_a, h_a = _windows(item, free_a, size)
    at_b, h_b = _windows(doc, free_b, size)
    keep = np.isin(h_b, h_a)
    at_b, h_b = at_b[keep], h_b[keep]
    order = np.argsort(h_b, kind="stable")
    at_b, h_b = at_b[order], h_b[order]
    lo, hi = np.searchsorted(h_b, h_a), np.searchsorted(h_b, h_a, side="right")
    load = np.cumsum(hi - lo)
    found, first = [], 0
    while first < len(at_a):
        done = load[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(load, done + MANY, side="right")))
        n = (hi - lo)[first:last]
        if n.sum():
            a = np.repeat(at_a[first:last], n)
            b = at_b[np.repeat(lo[first:last] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            found.append(_joined(b - a, a, np.ones(len(a), np.int64)))
        first = last
    if not found:
        return (np.empty(0, np.int64),) * 3
    d, a, n = (np.concatenate(x) for x in zip(*found))
    if len(found) > 1:
        d, a, n = _joined(d, a, n)
    return a, a + d, n


def _joined(d: np.ndarray, a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (diagonal, start, length) that follow each other without a gap made one."""
    order = np.lexsort((a, d))
    d, a, n = d[order], a[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(d) != 0) | (a[1:] != a[:-1] + n[:-1]))))
    return d[new], a[new], np.add.reduceat(n, new)


def _matches(item, doc, free_a, free_b, size) -> list[tuple[int, int, int]]:
    """Longest matches of at least ``size`` words that touch no tile: (negative length, start, start), a heap."""
    out = []
    for i, j, n in zip(*(x.tolist() for x in _runs(item, doc, free_a, free_b, size))):
        n += size - 1
        if (item[i : i + n] == doc[j : j + n]).all():
            out.append((-n, i, j))
    heapq.heapify(out)
    return out


# ---- tables

_SIZES = "item bigint, words array<bigint>, size int, seeds array<bigint>"


def _hash_of(word: str, known: dict[str, int]) -> int:
    if (n := known.get(word)) is None:
        if len(known) > 1_000_000:
            known.clear()
        n = known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) | 1
    return n


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _values(words: list[str], known: dict[str, int]) -> np.ndarray:
    return np.fromiter((_hash_of(w, known) for w in words), np.uint64, len(words))


def seeded_items(items: DataFrame, item_id: str, text: str, seed_words: int) -> DataFrame:
    """``u`` (a number for the row), ``item``, its ``words`` as hashes, the ``size`` of its seeds and the ``seeds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            ids, seqs = [], []
            for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if words := plain_words(s):
                    ids.append(i)
                    seqs.append(_values(words, known))
            sizes = [min(seed_words, len(s)) for s in seqs]
            seeds = [np.unique(window_hashes(s, n)) for s, n in zip(seqs, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(seqs), pa.array(sizes, pa.int32()), _lists(seeds)], ["item", "words", "size", "seeds"])

    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint"), text).mapInArrow(run, _SIZES)
    return materialise(rows.withColumn("u", F.monotonically_increasing_id()), "items")


def seed_filter(seeds: DataFrame, bits: int = FILTER_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Two bit maps, each of one stretch of the seeds' bits. What comes to the driver is as large for any seeds."""
    halves = []
    for shift in (0, bits):
        slot = F.shiftrightunsigned("seed", shift).bitwiseAND(F.lit((1 << bits) - 1))
        maps = seeds.select((slot + 1).alias("s"))  # both functions count from 1
        maps = maps.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
        whole = np.zeros(1 << bits >> 3, np.uint8)
        for n, m in maps.collect():  # at most 2 ** bits / 32768 rows of 4 KB
            whole[(n - 1) * 4096 : n * 4096] = np.frombuffer(m, np.uint8)
        halves.append(whole)
    return halves[0], halves[1]


def _passing(h: np.ndarray, maps: tuple[np.ndarray, np.ndarray], bits: int) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for shift, m in zip((0, bits), maps):
        slot = (h >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        ok &= (m[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok


def leaks(
    docs: DataFrame,
    items: DataFrame,
    min_tile: int = SEED_WORDS,
    seed_words: int = SEED_WORDS,
    min_coverage: float = 0.0,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Pairs of documents and items with ``tiles``, ``longest`` (words of the longest tile), ``covered`` (words of the
    item in tiles) and ``coverage`` (their share), for pairs with at least one tile of ``min_tile`` words (of a shorter
    item: all its words) and at least ``min_coverage``.

    Defined cases: null and empty texts and items without words take part in no pair; documents or items without an
    id are left out; a document or item that occurs twice is found twice; empty tables give no rows; texts are read
    to their end, however long; extra columns are not read.
    """
    schema = f"{item_id} bigint, {doc_id} bigint, tiles int, longest int, covered int, coverage double"
    held = seeded_items(items, item_id, text, seed_words)
    seeds = held.select("u", F.explode("seeds").alias("seed"))
    sizes = sorted(r[0] for r in held.select("size").distinct().collect())  # at most seed_words of them
    spark, maps = docs.sparkSession, seed_filter(seeds.select("seed"), filter_bits)
    sent = spark.sparkContext.broadcast(maps)  # of fixed size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, known = sent.value, {}
        for b in batches:
            ids, seqs, hits = [], [], []
            for d, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = plain_words(s)
                if not words:
                    continue
                seq = _values(words, known)
                windows = [window_hashes(seq, n) for n in sizes if n <= len(seq)]
                if not windows:
                    continue
                windows = np.concatenate(windows)
                found = np.unique(windows[_passing(windows, maps, filter_bits)])
                if len(found):
                    ids.append(d)
                    seqs.append(seq)
                    hits.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(seqs), _lists(hits)], ["doc", "words", "hits"])

    def tile(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for d, words in zip(mine.column("doc").to_pylist(), mine.column("words")):
            seq = np.asarray(words.values).view(np.uint64)
            for i, other in zip(theirs.column("item").to_pylist(), theirs.column("item_words")):
                item = np.asarray(other.values).view(np.uint64)
                t = tiles(item, seq, min(min_tile, len(item)))
                covered = sum(n for _, _, n in t)
                if t and covered >= min_coverage * len(item):
                    rows.append((i, d, len(t), max(n for _, _, n in t), covered, covered / len(item)))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        cols = list(zip(*rows)) if rows else [[]] * 6
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in schema.split(", ")])

    texts = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint"), text)
    touched = texts.mapInArrow(scan, "doc bigint, words array<bigint>, hits array<bigint>").withColumn("v", F.monotonically_increasing_id())
    touched = materialise(touched, "touched")
    # a seed that many documents share is a hot key of this join, which is broadcast or split by the engine
    pairs = touched.select("v", F.explode("hits").alias("seed")).join(broadcast_if_small(materialise(seeds, "seeds")), "seed").select("u", "v").distinct()
    pairs = materialise(pairs, "pairs")
    # items with their words beside each document, some at a time
    beside = pairs.join(held.select("u", "item", F.col("words").alias("item_words")), "u")
    part = F.pmod(F.xxhash64("u"), F.lit(max(1, -(-held.count() // ITEMS_AT_ONCE)))).alias("part")
    beside = beside.select("v", part, "item", "item_words")
    parts = pairs.select(F.col("v").alias("v"), part).distinct()
    whole = parts.join(touched.select("v", "doc", "words"), "v")
    return whole.groupBy("v", "part").cogroup(beside.groupBy("v", "part")).applyInArrow(tile, schema)
