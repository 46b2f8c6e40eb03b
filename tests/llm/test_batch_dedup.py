from fractions import Fraction

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from spoolwright.llm import batch_dedup as bd
from spoolwright.session import conf

SCHEMA = "record_seq bigint, table_name string, id_kind tinyint, id_int int, id_str string, data binary, note string, k string, seq int, bucket string"


def frame(spark, rows):
    return spark.createDataFrame([(s, t, k, i, n, d, "x", "clash", 1, "clash") for s, t, k, i, n, d in rows], SCHEMA)


def run(spark, history, batch, block_rows=bd.BLOCK_ROWS, bucket_rows=bd.BUCKET_ROWS):
    index = bd.AcceptedIndex.build(frame(spark, history), block_rows=block_rows, bucket_rows=bucket_rows)
    got = {(r.accepted_seq, r.new_seq) for r in bd.check_batch(index, frame(spark, batch), block_rows, bucket_rows).collect()}
    named = ("record_seq", "table_name", "id_kind", "id_int", "id_str", "data")
    want = brute.repeats([dict(zip(named, r)) for r in history], [dict(zip(named, r)) for r in batch if r[0] is not None])
    return got, want, index


TEN = b"one two three four five six seven eight nine ten"


def test_cases(spark):
    history = [
        (1, "user", 1, 5, None, TEN),
        (2, "user", 2, None, "5", TEN),
        (3, "user", 0, None, None, b"..."),
        (4, None, None, None, None, "привет мир раз два".encode("cp1251")),
        (5, "long", 1, 1, None, b" ".join(b"w%d" % i for i in range(20_000))),
        (6, "long", 1, 1, None, None),
    ]
    batch = [
        (100, "user", 1, 5, None, b"ONE two, three four five six seven eight nine ten!"),
        (101, "user", 1, 6, None, TEN),  # another key: accepted
        (102, "user", 1, 6, None, b"one two three four five six seven eight nine eleven"),  # 9 of 11
        (103, "user", 1, 6, None, b"one two three four five six seven eight twelve eleven"),  # 9 of 11 to 102, 8 of 12 to 101
        (104, "user", 0, None, None, b""),
        (105, None, None, None, None, "Привет, мир: раз-два".encode()),
        (106, "long", 1, 1, None, b" ".join(b"w%d" % i for i in range(19_000))),
        (107, "long", 1, 1, None, b"--"),
        (108, "new", 1, 1, None, b"a b c"),
        (109, "new", 1, 1, None, b"c b a a"),
        (None, "new", 1, 1, None, b"a b c"),
    ]
    got, want, index = run(spark, history, batch)
    assert got == want
    assert got == {(1, 100), (101, 102), (3, 104), (4, 105), (5, 106), (6, 107), (108, 109)}
    # what was accepted is in the index for the next batch
    later = bd.check_batch(index, frame(spark, [(200, "new", 1, 1, None, b"a b c"), (201, "user", 1, 6, None, b"eight twelve eleven one two three four five six seven")]))
    assert {(r.accepted_seq, r.new_seq) for r in later.collect()} == {(108, 200), (103, 201)}


def test_empty(spark):
    assert run(spark, [], [])[0] == set()
    assert run(spark, [], [(1, "a", 1, 1, None, b"x y"), (2, "a", 1, 1, None, b"y x")])[0] == {(1, 2)}
    assert run(spark, [(1, "a", 1, 1, None, b"x y")], [])[0] == set()


@pytest.mark.parametrize("block_rows", [20_000, 30])
def test_hot_key_and_chains(spark, block_rows):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]

    def text():
        return list(rng.choice(words, 14, replace=False))

    def edit(t, n):
        t = list(t)
        for i in rng.choice(len(t), n, replace=False):
            t[i] = str(rng.choice(words))
        return t

    texts = [text() for _ in range(40)]
    history = [(i, "hot" if i % 3 else f"cold{i % 7}", 1, 1, None, " ".join(texts[i % 40]).encode()) for i in range(120)]
    batch = [(1000 + i, "hot" if i % 3 else f"cold{i % 7}", 1, 1, None, " ".join(edit(texts[i % 40], int(rng.integers(0, 5)))).encode()) for i in range(150)]
    chain = text()
    for i in range(12):  # each repeats the one before, hardly the one before that
        batch.append((2000 + i, "hot", 1, 1, None, " ".join(chain).encode()))
        chain = edit(chain, 2)
    batch += [(3000 + i, "hot", 1, 1, None, b"the very same words") for i in range(200)]
    got, want, _ = run(spark, history, batch, block_rows, 20)
    assert got == want and len(got) > 200


def coded(texts):
    """Parts of (key, words) as numbers, one after another, and how many each has."""
    codes = [ord(k) * 1000 + ord(w) for k, ws in texts for w in sorted(ws)]
    return np.array(codes, np.int64), np.array([len(ws) for _, ws in texts], np.int64)


TEXTS = st.lists(st.tuples(st.sampled_from("ab"), st.sets(st.sampled_from("pqrstuvwxyz"), min_size=1)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS, TEXTS, st.sampled_from([Fraction(7, 10), Fraction(1, 2), Fraction(1), Fraction(1, 10)]), st.booleans())
def test_pairs_are_all_pairs(old, new, least, twice):
    codes, lens = coded(old)
    rows = np.repeat(np.arange(len(lens)), lens)
    q, q_lens = coded(new)
    shared = np.isin(codes, q)
    rows, codes = rows[shared], codes[shared]
    if twice:  # appended twice
        rows, codes = np.concatenate((rows, rows)), np.concatenate((codes, codes))
    got = [(int(a), int(b)) for x, y in bd.similar_pairs(rows, codes, lens, q, q_lens, least) for a, b in zip(x, y)]
    want = {(i, j) for i, (k, v) in enumerate(new) for j, (l, w) in enumerate(old) if k == l and len(v & w) >= least * len(v | w)}
    assert len(got) == len(set(got)) and set(got) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sets(st.sampled_from("pqrstuvw"), min_size=1)), max_size=40))
def test_settled_as_one_by_one(texts):
    few, bd.FEW = bd.FEW, 3
    try:
        got = bd.settle(np.arange(len(texts)) * 10, *coded(texts))
    finally:
        bd.FEW = few
    accepted = []
    for i, (k, v) in enumerate(texts):
        like = [j for j in accepted if texts[j][0] == k and 10 * len(v & texts[j][1]) >= 7 * len(v | texts[j][1])]
        assert got[i] == (min(like) * 10 if like else bd._NONE)
        if not like:
            accepted.append(i)


def test_many_near_copies_make_few_pairs(monkeypatch):
    made = []
    pairs = bd.similar_pairs

    def counted(*a, **k):
        for x, y in pairs(*a, **k):
            made.append(len(x))
            yield x, y

    monkeypatch.setattr(bd, "similar_pairs", counted)
    n = 10_000
    codes = np.array([c for i in range(n) for c in [*range(1, 20), 1000 + i]], np.int64)
    best = bd.settle(np.arange(n), codes, np.full(n, 20))
    assert (best[1:] == 0).all() and sum(made) < 3 * n


def test_only_buckets_asked_for_are_read(spark, monkeypatch):
    read = []
    held = bd.AcceptedIndex.held

    def seen(self, *a):
        read.append(held(self, *a))
        return read[-1]

    monkeypatch.setattr(bd.AcceptedIndex, "held", seen)
    history = [(i, f"t{i}", 1, 1, None, b"words of message %d" % i) for i in range(60)]
    got, want, _ = run(spark, history, [(100, "t7", 1, 1, None, b"7 message of words")], bucket_rows=3)
    assert got == want == {(7, 100)}
    (t,) = read[0]
    assert 0 < t.count() < 20  # 20 buckets of about three
    assert "SelectedBucketsCount: 1 out of 20" in t.groupBy("bucket").count()._jdf.queryExecution().toString()


def test_the_index_lies_still_and_holds_no_texts(spark, monkeypatch):
    history = [(i, f"t{i % 9}", 1, 1, None, b"words of message %d" % i) for i in range(200)]
    index = bd.AcceptedIndex.build(frame(spark, history), bucket_rows=10)
    (t,) = index.held()
    assert t.columns == ["bucket", "h", "seq", "parts"]
    wanted = frame(spark, history).select(F.col("id_int").alias("bucket"), F.col("record_seq").alias("p")).hint("shuffle_hash")
    with conf(spark, spark__sql__requireAllClusterKeysForCoPartition=False, spark__sql__adaptive__enabled=False):
        plan = t.select("bucket", F.explode("parts").alias("p")).join(wanted, ["bucket", "p"], "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(bucket") == 1 and "ShuffledHashJoin" in plan


def test_another_session_opens_the_index(spark, monkeypatch):
    history = [(i, "t", 1, 1, None, b"words of message %d" % i) for i in range(20)]
    index = bd.AcceptedIndex.build(frame(spark, history), block_rows=7, bucket_rows=5)
    bd.check_batch(index, frame(spark, [(100, "u", 1, 1, None, b"a b c d")]), 7, 5)
    monkeypatch.setattr(bd, "contents", lambda df, collapse=False, of=bd.contents: of(df) if not collapse else pytest.fail("texts were read"))
    again = bd.AcceptedIndex.open(spark, index.path)
    rows = [(200, "u", 1, 1, None, b"d c b a"), (201, "t", 1, 1, None, b"message of words 13"), (202, "t", 1, 1, None, b"quite another")]
    assert {tuple(r) for r in bd.check_batch(again, frame(spark, rows), 7, 5).collect()} == {(100, 200), (13, 201)}
    # a batch that broke off behind its append is checked again, with the same answers
    third = bd.AcceptedIndex.open(spark, index.path)
    assert {tuple(r) for r in bd.check_batch(third, frame(spark, rows), 7, 5).collect()} == {(100, 200), (13, 201)}
    with pytest.raises(FileNotFoundError):
        bd.AcceptedIndex.open(spark, index.path + "-none")


def test_smaller_numbers_of_new_messages(spark):
    """An accepted message of the batch can be the least, though the history holds one that is alike."""
    history = [(500, "a", 1, 1, None, b"p q r s t u v w x y")]
    batch = [(1, "a", 1, 1, None, b"p q r s t u v 1 2"), (2, "a", 1, 1, None, b"p q r s t u v w 1")]
    got, want, _ = run(spark, history, batch)
    assert got == want == {(1, 2)}


def test_the_oldest_alike_is_not_the_full_copy(spark):
    history = [(1, "a", 1, 1, None, TEN), (2, "a", 1, 1, None, TEN + b" eleven")]
    got, want, _ = run(spark, history, [(3, "a", 1, 1, None, TEN + b" eleven")])
    assert got == want == {(1, 3)}


def test_keys_that_grow_get_blocks(spark):
    index = bd.AcceptedIndex.build(frame(spark, []), block_rows=10, bucket_rows=10)
    named = ("record_seq", "table_name", "id_kind", "id_int", "id_str", "data")
    batches = [[(100 * b + i, "hot" if i % 5 else f"cold{i}", 1, 1, None, b"m%d n%d" % (i % 20 + 4 * b, i % 20 + 4 * b)) for i in range(40)] for b in range(1, 4)]
    got = set()
    for rows in batches:
        got |= {(r.accepted_seq, r.new_seq) for r in bd.check_batch(index, frame(spark, rows), 10, 10).collect()}
    assert got == brute.repeats([], [dict(zip(named, r)) for rows in batches for r in rows])
    sizes = [r["count"] for t in index.held() for r in t.groupBy("bucket").count().collect()]
    assert sum(sizes) > 20 and max(sizes) <= 14  # spread by hash, ten or fewer on average


def test_all_keys_that_grow_get_buckets(spark):
    index = bd.AcceptedIndex.build(frame(spark, []), block_rows=10, bucket_rows=10)
    for b in range(1, 4):
        bd.check_batch(index, frame(spark, [(1000 * b + i, f"k{b}-{i}", 1, 1, None, b"m%d" % i) for i in range(100)]), 10, 10)
    assert len(index.layout.cold) > 1 and len(index.tables) > 1
    sizes = [r["count"] for t in index.held() for r in t.groupBy("bucket").count().collect()]
    assert sum(sizes) == 300 and max(sizes) <= 40
    again = [(9000 + b, f"k{b}-7", 1, 1, None, b"m7") for b in range(1, 4)]
    assert {tuple(r) for r in bd.check_batch(index, frame(spark, again), 10, 10).collect()} == {(1000 * b + 7, 9000 + b) for b in range(1, 4)}


def test_batches(spark, sf):
    from spoolwright.llm.queries import p5_batches

    def rows(name):
        return [r.asDict() | {"data": r.data and bytes(r.data)} for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]

    assert {(r.accepted_seq, r.new_seq) for r in p5_batches(spark, sf).collect()} == brute.repeats(rows("records"), rows("new_records"))


def test_small_turns(monkeypatch):
    monkeypatch.setattr(bd, "AT_ONCE", 3)
    test_pairs_are_all_pairs()


def test_against_brute_force(spark, sf):
    from spoolwright.llm.queries import p5_found

    def rows(name):
        return [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]

    def plain(rs):
        return [r | {"data": None if r["data"] is None else bytes(r["data"])} for r in rs]

    got = {(r.accepted_seq, r.new_seq) for r in p5_found(spark, sf).collect()}
    assert got == brute.repeats(plain(rows("records")), plain(rows("new_records")))
