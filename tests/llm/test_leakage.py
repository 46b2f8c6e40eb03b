import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spoolwright.llm import leakage as lk
from spoolwright.llm.words import plain_words


def longest_common(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def brute(docs, items, least=13):
    out = set()
    its = [(i, plain_words(t)) for i, t in items]
    for d, text in docs:
        words = plain_words(text)
        for i, w in its:
            n = min(least, len(w))
            if n:
                grams = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
                if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
                    out.add((i, d))
    return out


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id bigint, text string, tiles int, item_id string"),
        spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id bigint, text string, coverage double"),
    )


ITEM = " ".join(f"word{i}" for i in range(40))


def test_cases(spark):
    w = ITEM.split()
    docs = [
        (1, "before " + ITEM + " after"),
        (2, " ".join(w[5:18])),
        (3, " ".join(w[5:17])),  # twelve words
        (4, "x " + "; ".join(w[20:34]).upper() + " y"),
        (5, "Ａlpha​beta gamma"),  # NFKC and a format character
        (6, None),
        (7, ""),
        (8, "mirror " * 50_000 + ITEM),
        (1, ITEM),
        (9, "a_b"),
    ]
    items = [(1, ITEM), (2, "alphabeta GAMMA"), (3, None), (4, " -- "), (5, ITEM), (6, "b")]
    d, i = frames(spark, docs, items)
    got = [(r.item_id, r.doc_id) for r in lk.leaks(d, i).collect()]
    assert set(got) == brute(docs, items) == {(k, n) for k in (1, 5) for n in (1, 2, 4, 8)} | {(2, 5), (6, 9)}
    assert len(got) == 12  # document 1 occurs twice, and so do its pairs
    # a filter that lets nearly everything pass changes nothing
    assert sorted(got) == sorted((r.item_id, r.doc_id) for r in lk.leaks(d, i, filter_bits=15).collect())
    assert lk.leaks(d.limit(0), i).collect() == [] and lk.leaks(d, i.limit(0)).collect() == []


def test_reordered_passage(spark):
    w = ITEM.split()
    mixed = w[30:] + ["and"] + w[:10] + ["then"] + w[20:30] + w[10:20]
    d, i = frames(spark, [(1, " ".join(mixed)), (2, " ".join(w[:20]))], [(1, ITEM)])
    rows = lk.leaks(d, i, min_tile=5, seed_words=5, min_coverage=0.8).collect()
    assert [(r.doc_id, r.tiles, r.longest, r.covered) for r in rows] == [(1, 4, 10, 40)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40), st.lists(st.integers(1, 4), max_size=60), st.integers(1, 6))
def test_tiles(a, b, least):
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    got = lk.tiles(x, y, least)
    seen_a, seen_b = set(), set()
    for i, j, n in got:
        assert n >= least and a[i : i + n] == b[j : j + n]
        assert not seen_a & set(range(i, i + n)) and not seen_b & set(range(j, j + n))
        seen_a |= set(range(i, i + n))
        seen_b |= set(range(j, j + n))
    most = longest_common(a, b)
    assert max((n for _, _, n in got), default=0) == (most if most >= least else 0)
    # nothing is left that could still be marked
    free = lambda seq, seen: [v if k not in seen else -k - (1 if seq is a else 1000) for k, v in enumerate(seq)]
    assert longest_common(free(a, seen_a), free(b, seen_b)) < least


def tiles_one_by_one(a, b, least):
    """Greedy string tiling by looking at everything anew for each tile."""
    out, used_a, used_b = [], set(), set()
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                best = min(best, (-n, i, j))
        n, i, j = best
        if -n < least:
            return out
        out.append((i, j, -n))
        used_a |= set(range(i, i - n))
        used_b |= set(range(j, j - n))


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 2), max_size=40), st.lists(st.integers(1, 2), max_size=50), st.integers(1, 6), st.sampled_from([2_000_000, 10, 1]))
def test_longest_first_whatever_is_looked_at_in_one_go(a, b, least, many):
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    old, lk.MANY = lk.MANY, many
    try:
        got = lk.tiles(x, y, least)
    finally:
        lk.MANY = old
    want = tiles_one_by_one(a, b, least)
    assert sorted(n for _, _, n in got) == sorted(n for _, _, n in want) and got == want


def test_equal_words_are_one_tile():
    x = np.full(3000, 7, np.uint64)
    assert lk.tiles(x, x, 13) == [(0, 0, 3000)]
    assert lk.tiles(x, np.full(7000, 7, np.uint64), 13)[0] == (0, 0, 3000)


def test_items_stay_off_the_driver(spark):
    """What comes to the driver is the filter, as large for ten times the items."""
    seeds = spark.range(1000).select(F.xxhash64("id").alias("seed"))
    few, many = lk.seed_filter(seeds.limit(100), 20), lk.seed_filter(seeds, 20)
    assert [m.nbytes for m in few] == [m.nbytes for m in many] == [1 << 17] * 2
    h = np.array([r[0] for r in seeds.collect()], np.int64).view(np.uint64)
    assert lk._passing(h, many, 20).all() and lk._passing(h ^ np.uint64(0x5A5A5A5A5A5A5A5A), many, 20).sum() < 30


def test_window_hashes():
    rng = random.Random(4)
    v = np.array([rng.randrange(1, 4) for _ in range(300)], np.uint64)
    h = lk.window_hashes(v, 5)
    by = {}
    for k in range(len(h)):
        by.setdefault(int(h[k]), set()).add(tuple(v[k : k + 5].tolist()))
    assert len(h) == 296 and all(len(s) == 1 for s in by.values())


def test_against_brute_force(spark, sf):
    from spoolwright.llm.queries import p7_found

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/eval_items.parquet").select("item_id", "text").collect()]
    assert {tuple(r) for r in p7_found(spark, sf).collect()} == brute(docs, items)
