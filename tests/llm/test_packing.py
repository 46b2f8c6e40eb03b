from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spoolwright.llm import packing as pk
from spoolwright.llm.tokens import tokenizer


def check(rows, sizes, capacity):
    """Every item whole or in pieces of the capacity, no container too full, numbers without gaps."""
    held, places, parts = Counter(), defaultdict(list), defaultdict(list)
    for r in rows:
        held[r["container"]] += r["n_tokens"]
        places[r["container"]].append(r["place"])
        parts[r["id"]].append((r["piece"], r["n_tokens"]))
    assert all(n <= capacity for n in held.values())
    assert sorted(held) == list(range(len(held)))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    for i, n in sizes.items():
        n = max(n or 0, 0)
        whole, rest = divmod(n, capacity)
        want = [capacity] * whole + ([rest] if rest or not whole else [])
        assert [x for _, x in sorted(parts[i])] == want and [p for p, _ in sorted(parts[i])] == list(range(len(want)))
    return len(held)


def run(spark, sizes, capacity=4096, **how):
    df = spark.createDataFrame([(i, n, "x", 1, 2) for i, n in sizes.items()], "id bigint, n_tokens bigint, bin string, rank int, part int")
    return [r.asDict() for r in pk.pack(df, "id", "n_tokens", capacity, **how).collect()]


def test_cases(spark):
    sizes = {1: 4096, 2: 4097, 3: 0, 4: None, 5: 100_000, 6: 1, 7: -3, 8: 2048, 9: 2048, 10: 4095, 11: 8192}
    check(run(spark, sizes), sizes, 4096)
    assert run(spark, {}) == []


def test_fills_well(spark):
    rng = np.random.default_rng(2)
    sizes = {i: int(n) for i, n in enumerate(np.clip(rng.lognormal(6.6, 0.6, 3000), 1, 4096))} | {10_000 + i: 700 for i in range(1500)}
    n = check(run(spark, sizes), sizes, 4096)
    assert sum(sizes.values()) / (n * 4096) > 0.97


def test_ranks_in_parts(spark, monkeypatch):
    monkeypatch.setattr(pk, "RANK_ROWS", 3)
    sizes = {i: 10 if i % 3 else 33 for i in range(200)}
    check(run(spark, sizes, 100, bins=10), sizes, 100)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=12, max_size=12), st.integers(1, 4))
def test_plan_places_all(counts, depth):
    counts = np.array([0, *counts])
    used = Counter()
    for pattern, n in pk.plan(counts, depth):
        assert sum(pattern) <= 12 and n > 0
        for x in pattern:
            used[x] += n
    assert used == Counter({i: int(c) for i, c in enumerate(counts) if c})


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_patterns(depth):
    usable = np.array([1, 2, 3, 5, 8])

    def every(left, most, d):
        if left == 0:
            yield ()
        elif d:
            for n in usable:
                if n <= min(left, most):
                    for rest in every(left - n, n, d - 1):
                        yield (int(n), *rest)

    got = [tuple(int(v) for v in r if v) for r in pk.patterns(8, depth, usable)]
    assert len(got) == len(set(got)) and set(got) == set(every(8, 8, depth))


def test_nnls_recovers_a_mixture():
    rows = pk.patterns(10, 3, np.arange(1, 11))
    rng = np.random.default_rng(3)
    x = np.zeros(len(rows))
    x[rng.choice(len(rows), 4, replace=False)] = [100, 50, 70, 20]
    counts = np.zeros(11)
    for r, n in zip(rows, x):
        for v in r[r > 0]:
            counts[v] += n
    y = pk.nnls(rows, counts)
    again = np.zeros(11)
    for r, n in zip(rows, y):
        for v in r[r > 0]:
            again[v] += n
    assert (y >= 0).all() and np.allclose(again, counts, atol=1e-4)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    t = tokenizer()
    sizes = {r.doc_id: t.count(r.text or "") for r in docs.select("doc_id", "text").collect()}
    check([r.asDict() | {"id": r["doc_id"]} for r in pk.pack_documents(docs).collect()], sizes, 4096)
