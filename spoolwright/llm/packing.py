"""Filling containers of fixed capacity with items of varying length.

Items are known to the planner by their length alone, in ``bins`` of ``capacity / bins`` tokens, rounded up so that a
plan always fits. All patterns of up to ``depth`` lengths that fill a container exactly are enumerated; repeat counts
that explain the histogram best are found by non-negative least squares, rounded down, and what remains is packed by
patterns built largest first, each repeated as often as its lengths last. The planner's work depends on the number of
bins, never on the number of items; only the histogram, ``bins`` counts, comes to the driver.

Items then take their places by rank within their bin, which is a join with the plan's runs and no window over a whole
bin: a bin that holds a third of all items is ranked in pieces, whose offsets are summed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialise
from .tokens import with_token_count

CAPACITY = 4096
BINS = 256
DEPTH = 3
#: Items that are ranked in one go, about.
RANK_ROWS = 1_000_000


def patterns(bins: int, depth: int, usable: np.ndarray) -> np.ndarray:
    """All non-increasing rows of up to ``depth`` usable lengths (1 to ``bins``) that sum to ``bins``; zeros pad."""
    ok = np.zeros(bins + 1, bool)
    ok[usable] = True
    found = []
    # (prefix, its sum, its last length): grown by one length at a time, all at once
    prefix, total, last = np.zeros((1, 0), np.int64), np.zeros(1, np.int64), np.full(1, bins)
    for d in range(depth):
        left = bins - total
        done = (left >= 1) & (left <= last) & ok[np.clip(left, 0, bins)]
        rows = np.concatenate([prefix[done], left[done, None]], axis=1)
        found.append(np.pad(rows, ((0, 0), (0, depth - d - 1))))
        if d == depth - 1:
            break
        grown = []
        for n in usable:
            # the rest must still be reachable with lengths of at most n
            fits = (n <= last) & (left > n) & (left - n <= n * (depth - d - 1))
            grown.append((np.concatenate([prefix[fits], np.full((fits.sum(), 1), n)], axis=1), total[fits] + n, np.full(fits.sum(), n)))
        prefix, total, last = (np.concatenate(x) for x in zip(*grown)) if grown else (prefix[:0], total[:0], last[:0])
    return np.concatenate(found)


def nnls(rows: np.ndarray, counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Repeat counts ``x >= 0`` with the least squared difference between the lengths that the patterns use and
    ``counts``, by active sets (Lawson and Hanson). Longer lengths weigh more, as they are harder to place later."""
    n = len(counts)
    weight = np.sqrt(np.arange(n) / n)
    scale = max(1.0, float(counts.max()))
    b = counts / scale * weight
    x = np.zeros(len(rows))
    active: list[int] = []
    gram_cols: dict[int, np.ndarray] = {}

    def column(p: int) -> np.ndarray:
        if p not in gram_cols:
            c = np.bincount(rows[p], minlength=n).astype(float)
            c[0] = 0
            gram_cols[p] = c * weight
        return gram_cols[p]

    for _ in range(limit or 3 * n):
        r = b - (np.stack([column(p) for p in active], 1) @ x[active] if active else 0)
        g = (r * weight)
        g[0] = 0
        gain = g[rows].sum(1)
        gain[active] = -np.inf
        p = int(np.argmax(gain))
        if gain[p] < 1e-9:
            break
        active.append(p)
        while active:
            z = np.linalg.lstsq(np.stack([column(q) for q in active], 1), b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[active] = z
                break
            xa = x[active]
            low = z <= 0
            step = np.min(xa[low] / np.maximum(xa[low] - z[low], 1e-300))
            xa = xa + step * (z - xa)
            x[:] = 0
            x[active] = np.maximum(xa, 0)
            active = [q for q, v in zip(active, xa) if v > 1e-12]
    return x * scale


def plan(counts: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with how often each is used; every item of ``counts`` (by length, 0 unused) is placed exactly once."""
    counts = counts.astype(np.int64).copy()
    bins = len(counts) - 1
    out: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: list[int], most: int) -> None:
        lengths, each = np.unique(pattern, return_counts=True)
        n = int(min(most, (counts[lengths] // each).min()))
        if n > 0:
            counts[lengths] -= n * each
            out.append((tuple(pattern), n))

    usable = np.flatnonzero(counts)
    if len(usable):
        rows = patterns(bins, depth, usable)
        if len(rows):
            x = nnls(rows, counts.astype(float))
            for p in np.argsort(-x):
                if x[p] < 1:
                    break
                use([int(v) for v in rows[p] if v], int(x[p]))
    while counts.any():  # each turn uses up a length at least
        pattern, room, have = [], bins, counts.copy()
        for n in np.flatnonzero(have)[::-1]:
            k = int(min(have[n], room // n))
            pattern += [int(n)] * k
            room -= k * n
            if not room:
                break
        use(pattern, int(counts.sum()))
    return out


def runs(used: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """The plan from the items' side: for each length, which ranks go where. Rows of (bin, first rank, rank after the
    last, first container, items of the bin in a container, first place)."""
    taken: dict[int, int] = {}
    out, container = [], 0
    for pattern, n in used:
        place = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            at = taken.get(length, 0)
            out.append((length, at, at + each * n, container, each, place))
            taken[length] = at + each * n
            place += each
        container += n
    return out


def pack(items: DataFrame, row_id: str, size: str, capacity: int = CAPACITY, bins: int = BINS, depth: int = DEPTH) -> DataFrame:
    """Places items in containers: ``row_id``, ``piece``, ``container``, ``place`` and ``n_tokens``.

    An item larger than ``capacity`` is split into pieces of exactly ``capacity`` and a rest; all others stay whole, as
    piece 0. Containers and places count from 0, without gaps.

    Defined cases: null and zero sizes are placed as items without tokens that take up a bin's least room; negative
    sizes are taken as zero; rows with equal ids are items of their own; an empty table gives no rows; extra columns
    are not read. ``row_id`` breaks ties of rank and should be unique, else equal items may change places.
    """
    spark = items.sparkSession
    n = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    width = -(-capacity // bins)
    rows = items.select(F.col(row_id).alias("id"), n.alias("n"))
    last = F.greatest(F.floor((F.col("n") - 1) / capacity), F.lit(0))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn(
        "n", F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity))
    )
    rows = materialise(rows.withColumn("bin", F.greatest(F.ceil(F.col("n") / width), F.lit(1)).cast("int")), "items")
    total = rows.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANK_ROWS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.lit(parts)).cast("int"))
    sizes = materialise(rows.groupBy("bin", "part").agg(F.count(F.lit(1)).alias("k")), "bin-sizes")
    counts = np.zeros(-(-capacity // width) + 1, np.int64)
    for r in sizes.groupBy("bin").agg(F.sum("k").alias("k")).collect():  # a row for each bin
        counts[r["bin"]] = r["k"]
    schema = "bin int, first bigint, after bigint, container0 bigint, each bigint, place0 bigint"
    where = spark.createDataFrame(runs(plan(counts, depth)), schema)

    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bin", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("bin", "part").orderBy("id", "piece"))
    ranked = rows.withColumn("nth", nth).join(broadcast_if_small(offsets), ["bin", "part"])
    ranked = ranked.withColumn("rank", F.col("offset") + F.col("nth") - 1)
    # the plan has some runs for each of the bins, however many items there are
    placed = ranked.join(F.broadcast(where), (ranked["bin"] == where["bin"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after")))
    at = F.col("rank") - F.col("first")
    return placed.select(
        F.col("id").alias(row_id),
        "piece",
        (F.col("container0") + F.floor(at / F.col("each"))).alias("container"),
        (F.col("place0") + at % F.col("each")).alias("place"),
        F.col("n").alias("n_tokens"),
    )


def pack_documents(docs: DataFrame, row_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ranks_file: str | None = None, pattern: str | None = None, **how) -> DataFrame:
    """``pack`` by the number of tokens of each whole text."""
    sized = with_token_count(docs, row_id, text, ranks_file, pattern)
    return pack(sized, row_id, "n_tokens", capacity, **how)
