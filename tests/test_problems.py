"""The general problems' operators: defined cases, skew, and results against plain Python."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoolwright.operators import compaction as cp
from spoolwright.operators import deliveries as dl
from spoolwright.operators import history as hs
from spoolwright.operators import numbering as nb
from spoolwright.plans.adapters import scattered
from spoolwright.operators.tree_aggregate import rounds, tree_aggregate
from spoolwright.schema import KEY
from spoolwright.session import conf, fresh_path

# ---- tree aggregation


@pytest.mark.parametrize("chunks,fan_in,n", [(1, 8, 1), (8, 8, 1), (9, 8, 2), (64, 8, 2), (65, 8, 3), (1000, 10, 3), (0, 2, 1)])
def test_rounds(chunks, fan_in, n):
    assert rounds(chunks, fan_in) == n


@pytest.mark.parametrize("fan_in,chunks", [(2, None), (2, 64), (8, None), (3, 1)])
def test_tree_aggregate(spark, fan_in, chunks):
    rng = np.random.default_rng(5)
    rows = [("hot" if rng.random() < 0.5 else None if rng.random() < 0.1 else f"k{rng.integers(20)}", int(rng.integers(100)) if rng.random() < 0.9 else None) for _ in range(2000)]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "k string, v bigint, node int, k0 string").repartition(16)
    got = tree_aggregate(df, ["k"], {"n": ("count", F.lit(1)), "some": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "all": ("sum", "v")}, fan_in, chunks)
    want = defaultdict(list)
    for k, v in rows:
        want[k].append(v)
    assert {tuple(r) for r in got.collect()} == {
        (k, len(v), len(s), min(s, default=None), max(s, default=None), sum(s) if s else None) for k, v in want.items() for s in [[x for x in v if x is not None]]
    }


def test_tree_has_its_rounds_and_no_wide_reducer(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k"), "id").repartition(27)
    got = tree_aggregate(df, ["k"], {"n": ("count", "id")}, 3, 27)
    with conf(spark, spark__sql__adaptive__enabled=False):
        plan = tree_aggregate(df, ["k"], {"n": ("count", "id")}, 3, 27)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3
    assert got.collect()[0].n == 1000


def test_tree_empty_and_names(spark):
    df = spark.createDataFrame([], "k string, m0 bigint, node string")
    assert tree_aggregate(df, ["k"], {"m0": ("sum", "m0")}).collect() == []
    assert tree_aggregate(df, ["k", "node"], {"m0": ("sum", "m0")}).columns == ["k", "node", "m0"]
    with pytest.raises(ValueError):
        tree_aggregate(df, ["k"], {"x": ("median", "m0")})


# ---- deliveries

RECORD = "record_seq bigint, table_name string, id_kind tinyint, id_int int, id_str string, ts bigint, data binary, o string, p int, late int"


def records(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], RECORD)


ROWS = [
    (5, "t", 1, 7, None, 10, "привет".encode()),
    (2, "t", 1, 7, None, 10, "привет".encode("cp1251")),  # the same message in another encoding
    (3, "t", 2, None, "7", 10, "привет".encode()),
    (4, "t", 1, 7, None, 11, "привет".encode()),
    (6, None, None, None, None, None, None),
    (7, None, None, None, None, None, None),
    (8, None, None, None, None, None, b""),
    (9, "T", 1, 7, None, 10, "привет".encode()),
    (10, "long", 1, 7, None, 10, b"x" * 3_000_000),
    (11, "long", 1, 7, None, 10, b"x" * 3_000_000),
    (12, "long", 1, 7, None, 10, b"x" * 2_999_999 + b"y"),
    (None, "t", 1, 7, None, 10, "привет".encode()),
]


def test_repeated_deliveries(spark):
    got = [r[0] for r in dl.repeated_deliveries(records(spark, ROWS), dl.message_identity(), "record_seq").collect()]
    assert sorted(got) == [5, 7, 11]
    assert dl.repeated_deliveries(records(spark, []), dl.message_identity(), "record_seq").collect() == []


def test_first_deliveries(spark):
    df = records(spark, ROWS).withColumn("o", F.lit("clash"))
    got = dl.first_deliveries(df, dl.message_identity(), F.col("record_seq"), [F.col("record_seq")], ["record_seq", "o", "late"])
    assert sorted(r.record_seq for r in got.collect()) == [2, 3, 4, 6, 8, 9, 10, 12]
    assert got.columns == ["record_seq", "o", "late"]
    # a null delivery time comes last, ties go by the tie-break
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 9), ("a", 5, 3), ("b", None, 2)], "k string, at bigint, tie int")
    got = dl.first_deliveries(df, [F.col("k")], F.col("at"), [F.col("tie")], ["k", "tie"])
    assert {tuple(r) for r in got.collect()} == {("a", 3), ("b", 2)}


def test_copies_are_reduced_before_the_shuffle(spark):
    df = spark.range(20_000, numPartitions=4).select(
        F.col("id").alias("record_seq"), F.lit("t").alias("table_name"), F.lit(1).alias("id_kind"), F.lit(1).alias("id_int"), F.lit(None).cast("string").alias("id_str"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("ts"), F.lit(b"x").alias("data"),
    )
    assert dl.repeated_deliveries(df, dl.message_identity(), "record_seq").count() == 20_000 // 3 + 1  # all thirds but one, and the row of ts 1
    assert KEY == ["table_name", "id_kind", "id_int", "id_str"]


# ---- consolidation

SOURCE = "file_no bigint, pos int, table_name string, id_kind tinyint, id_int int, id_str string, log_bytes binary, ts bigint, small string, folder string"


def consolidate(spark, rows, files, **how):
    r = spark.createDataFrame([(*x, "x", "x") for x in rows], SOURCE)
    f = spark.createDataFrame(files, "file_no bigint, file_path string, valid_bytes int")
    return cp.consolidate_spool(spark, scattered(r, fresh_path(spark, "small")), f, fresh_path(spark, "spool"), **how)


def test_consolidation(spark):
    big = b"b" * 9000
    rows = [
        (1, 0, "t", 1, 1, None, b"a", 5),
        (1, 1, "t", 1, 1, None, b"a", 5),  # repeated
        (2, 0, "t", 1, 1, None, b"a", 5),  # repeated in a later file
        (2, 1, "t/../x=1 %", 2, None, "s", b"c", 5),
        (2, 2, None, 1, 1, None, b"c", 5),
        (2, 3, "", 1, 1, None, b"c", 5),
        (2, 4, "\0", 1, 1, None, b"c", 5),
        (2, 5, "t", 1, 1, None, b"", 5),
        (2, 6, "t", 1, 1, None, None, 5),
        (3, 0, "t", 1, 2, None, b"d", 5),  # not published
        (4, 0, "t", 1, 3, None, b"e", 5),  # not listed
        (5, 0, "t", None, None, None, big, None),
        (5, 1, "007", None, None, None, b"f", None),
        (6, 0, "7", 1, 1, None, b"a", 5),
        (None, 0, "7", 1, 9, None, b"a", 5),
    ]
    files = [(1, "/x/a.saved", 1), (2, "/x/b.saved.gz", 1), (2, "/x/b2.saved", 1), (3, "/x/c.SAVED", 1), (5, "/x/d.saved", 1), (6, "/x/e.saved", 1), (7, None, 1), (None, "/x/f.saved", 1)]
    got = {(r.table_name, r.file_no, r.pos, r.small) for r in consolidate(spark, rows, files).collect()}
    assert got == {("t", 1, 0, True), ("t/../x=1 %", 2, 1, True), ("t", 5, 0, False), ("007", 5, 1, False), ("7", 6, 0, True)}
    assert consolidate(spark, [], files).collect() == []
    assert consolidate(spark, rows, []).collect() == []


def test_packing_of_files(spark, tmp_path):
    src, dst = f"file://{tmp_path}/src", f"file://{tmp_path}/dst"
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "x").otherwise(None).alias("s"), (F.col("id") % 4).alias("p"), F.create_map(F.lit("a"), "id").alias("m"))
    df.repartition(60).write.partitionBy("p").parquet(src)
    done = cp.pack_small_files(spark, src, dst, target_bytes=1 << 20)
    assert set(done) == {f"p={k}" for k in range(4)} and all(a >= 30 and b == 1 for a, b in done.values())
    assert cp.fingerprint(spark.read.parquet(dst).select(df.columns)) == cp.fingerprint(df.withColumn("p", F.col("p").cast("int")))
    # the size of files is kept to
    few = cp.pack_small_files(spark, src, dst, target_bytes=8000)
    assert all(1 < b < a for a, b in few.values())
    assert int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b")) == 128 << 20  # settings are as before
    (tmp_path / "none").mkdir()
    assert cp.pack_small_files(spark, f"file://{tmp_path}/none", dst) == {"": (0, 0)}


def test_packing_is_verified(spark, tmp_path, monkeypatch):
    src, dst = f"file://{tmp_path}/src", f"file://{tmp_path}/dst"
    spark.range(10).write.parquet(src)
    monkeypatch.setattr(cp, "fingerprint", lambda df: (10, 2, 1))
    with pytest.raises(cp.VerificationError):
        cp.pack_small_files(spark, src, dst)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["src"] and spark.read.parquet(src).count() == 10


def test_packing_is_all_or_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cp, "AT_ONCE", 2)
    src, dst = f"file://{tmp_path}/src", f"file://{tmp_path}/dst"
    spark.range(60).select("id", (F.col("id") % 5).alias("p")).repartition(6).write.partitionBy("p").parquet(src)
    spark.range(3).write.parquet(f"{dst}/p=old")
    check, turn = cp._write_checked, iter(range(9))

    def third(*a):
        check(*a)
        if next(turn) == 2:
            raise cp.VerificationError("the third group")

    monkeypatch.setattr(cp, "_write_checked", third)
    with pytest.raises(cp.VerificationError):
        cp.pack_small_files(spark, src, dst)
    assert [p.name for p in (tmp_path / "dst").iterdir()] == ["p=old"]
    # a run that ended between the renames: the old files are put back, then replaced, and folders no longer there go
    (tmp_path / "dst").rename(tmp_path / "dst_replaced")
    monkeypatch.setattr(cp, "_write_checked", check)
    assert set(cp.pack_small_files(spark, src, dst)) == {f"p={k}" for k in range(5)}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["dst", "src"]
    assert spark.read.parquet(dst).count() == 60 and not (tmp_path / "dst" / "p=old").exists()


def test_fingerprint(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, `b.c` string")
    assert cp.fingerprint(a) == cp.fingerprint(a.repartition(3)) != cp.fingerprint(a.distinct())
    assert cp.fingerprint(a.limit(0)) == (0, 0, 0)
    b = spark.createDataFrame([(None, "a"), ("x", None)], "p string, q string")
    assert cp.fingerprint(b) != cp.fingerprint(b.select(F.col("q").alias("p"), F.col("p").alias("q")))


# ---- history

ATTRS = ["tier", "state"]
UPDATE = "k string, at bigint, seq bigint, tier string, set_tier boolean, state string, set_state boolean, period string, n int, next_at int"


def fold(rows):
    """Plain versions: (key, from, to, values)."""
    by = defaultdict(list)
    for r in rows:
        if r[1] is not None:
            by[r[0]].append(r)
    out = set()
    for k, rs in by.items():
        rs.sort(key=lambda r: (r[1], r[2]))
        state, events, last = {}, [], (None, None)
        for i, r in enumerate(rs):
            if r[4]:
                state["tier"] = r[3]
            if r[6]:
                state["state"] = r[5]
            if i + 1 == len(rs) or rs[i + 1][1] != r[1]:
                now = (state.get("tier"), state.get("state"))
                if now != last:
                    events.append((r[1], now))
                    last = now
        for (a, v), b in zip(events, [e[0] for e in events[1:]] + [None]):
            if v != (None, None):
                out.add((k, a, b, v))
    return out


@pytest.mark.parametrize("rows_per_period", [250_000, 40, 3])
def test_versions(spark, rows_per_period):
    rng = np.random.default_rng(6)
    pick = lambda: [None, "a", "b"][rng.integers(3)]
    rows = [
        ("hot" if rng.random() < 0.4 else None if rng.random() < 0.1 else f"k{rng.integers(5)}", int(rng.integers(60)) - 5, i, pick(), bool(rng.integers(2)), pick(), bool(rng.integers(2)))
        for i in range(400)
    ] + [("k1", None, 1000, "a", True, "a", True)]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], UPDATE)
    got = hs.versions(df, ["k"], ATTRS, rows_per_period).where("kind <> 'deleted'")
    rows_got = [(r.k, r.valid_from, r.valid_to, (r.tier, r.state)) for r in got.collect()]
    assert len(rows_got) == len(set(rows_got)) and set(rows_got) == fold(rows)


def test_version_kinds(spark):
    rows = [("e", 1, 1, "a", True, None, False), ("e", 2, 2, "a", True, None, False), ("e", 3, 3, "b", True, None, False), ("e", 4, 4, None, True, None, True), ("e", 5, 5, "b", True, None, True)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], UPDATE)
    got = [(r.kind, r.valid_from, r.valid_to) for r in hs.versions(df, ["k"], ATTRS).orderBy("valid_from").collect()]
    assert got == [("inserted", 1, 3), ("changed", 3, 4), ("deleted", 4, 5), ("inserted", 5, None)]
    assert hs.versions(df.limit(0), ["k"], ATTRS).collect() == []


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"op":"full","tier":" Gold ","quota":5,"state":null,"zone":""}', ("full", {"tier": "gold", "quota": "5"}, 5)),
        ('{"op": "PATCH", "state": null, "zone": "Z1"}', ("patch", {"zone": "z1"}, 2)),
        ("patch; tier = Basic ;owner=", ("patch", {"tier": "basic"}, 2)),
        ("full;zone=z1;zone=z2", ("full", {"zone": "z2"}, 5)),
        ("drop", ("drop", {}, 5)),
        ("DROP", ("drop", {}, 5)),
        (" FULL\r\nowner: Ann Bee\r\nquota: 7\r\n", ("full", {"owner": "ann bee", "quota": "7"}, 5)),
        ("PATCH\nzone:\n", ("patch", {}, 1)),
        ("patch by someone", (None, {}, 0)),
        ('{"op":"full"', (None, {}, 0)),
        ('{"tier":"x"}', (None, {}, 0)),
        ('["full"]', (None, {}, 0)),
        ("", (None, {}, 0)),
        (None, (None, {}, 0)),
        ("dropped; tier=a", (None, {}, 0)),
        ("full; note: " + "x" * 100_000 + ";tier=a", ("full", {"tier": "a"}, 5)),
    ],
)
def test_parse_updates(spark, text, want):
    df = spark.createDataFrame([(text, "clash", "clash")], "t string, tier string, op string").drop("op")
    r = hs.parse_updates(df, F.col("t")).first()
    assert (r.op, {a: r[a] for a in hs.ATTRIBUTES if r[a] is not None} if r.op else {}, sum(bool(r[f"set_{a}"]) for a in hs.ATTRIBUTES)) == want


# ---- numbering


def test_numbered(spark):
    rng = np.random.default_rng(7)
    rows = [(int(x), int(rng.integers(1, 9))) for x in rng.permutation(3000)]
    df = spark.createDataFrame(rows, "k int, size int").repartition(5)
    got = {r.k: (r.n, r.total) for r in nb.numbered(df, ["k"], "n", {"total": "size"}).collect()}
    total = 0
    for i, (k, s) in enumerate(sorted(rows)):
        total += s
        assert got[k] == (i, total)
    assert nb.numbered(df.limit(0), ["k"]).collect() == []


def test_found_queries_are_whole(spark, sf):
    from spoolwright.plans import problems

    n = spark.read.parquet(f"{sf}/records.parquet").count()
    assert problems.p2_found(spark, sf).count() + problems.p2_first_deliveries(spark, sf).count() == n
    stats = problems.p1_key_stats(spark, sf).collect()
    assert sum(r.messages for r in stats) == problems.p2_first_deliveries(spark, sf).count()
    assert max(Counter((r.table_name, r.id_key) for r in stats).values()) == 1


def test_first_deliveries_are_hashed(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("k"), F.timestamp_millis(F.col("id") % 3).alias("at"), F.lit("x").alias("s"))

    def plan(*a):
        with conf(spark, spark__sql__adaptive__enabled=False):
            return dl.first_deliveries(df, *a)._jdf.queryExecution().executedPlan().toString()

    for a in ((["k"], F.col("id"), [], ["id", "k"]), (["k"], F.col("at"), [F.col("id")], ["id"]), (["k", "s"], F.col("at"), [], ["s", "k"])):
        assert "SortAggregate" not in plan(*a) and "HashAggregate" in plan(*a)
    assert "SortAggregate" in plan(["k"], F.col("id"), [], ["id", "s"])


def test_packed_order_is_that_of_the_struct(spark):
    rows = [("a", None, 1), ("a", -5, 9), ("a", -5, -(2**63)), ("b", None, 4), ("b", None, None), ("c", 253402300799, 2**63 - 1), ("c", None, 0), ("d", 0, None), ("d", 0, -3)]
    df = spark.createDataFrame(rows, "k string, s bigint, tie bigint").withColumn("at", F.timestamp_seconds("s"))
    got = {tuple(r) for r in dl.first_deliveries(df, ["k"], F.col("at"), [F.col("tie")], ["k", "tie"]).collect()}
    assert got == {("a", -(2**63)), ("b", None), ("c", 2**63 - 1), ("d", None)}


def test_chunks_follow_the_plan(spark, tmp_path):
    from spoolwright.operators.tree_aggregate import plan_chunks

    at = str(tmp_path / "many")
    spark.range(200).repartition(40).write.parquet(at)
    with conf(spark, spark__sql__files__maxPartitionBytes=1 << 20, spark__sql__files__openCostInBytes=1 << 20):
        df = spark.read.parquet(at)
        assert plan_chunks(df) >= 40 and plan_chunks(df.join(df, "id").groupBy("id").count()) >= 40
    assert plan_chunks(spark.range(10)) == 4


def test_snapshots(spark):
    s = "k string, tier string, state string, kind string"
    a = spark.createDataFrame([("a", "x", None, "c"), (None, "x", "y", "c"), ("b", None, "z", "c"), ("gone", "x", "x", "c"), ("void", None, None, "c"), ("a", None, "q", "c")], s)
    b = spark.createDataFrame([("a", "x", None, "c"), (None, "x", None, "c"), ("b", None, "z", "c"), ("void", None, "w", "c")], s)
    got = {(r.k, r.kind, r.tier, r.state) for r in hs.snapshot_changes(a, b, ["k"], ATTRS).collect()}
    assert got == {(None, "changed", "x", None), ("gone", "deleted", None, None), ("void", "inserted", None, "w")}
    assert hs.snapshot_changes(a, b.limit(0), ["k"], ATTRS).where("kind = 'deleted'").count() == 4
    got = {(r.k, r.kind, r.valid_from, r.valid_to) for r in hs.versions_of_snapshots([(20, b), (10, a), (30, a)], ["k"], ATTRS).collect()}
    want = {("a", "inserted", 10, None), (None, "inserted", 10, 20), (None, "changed", 20, 30), (None, "changed", 30, None), ("b", "inserted", 10, None)}
    want |= {("gone", "inserted", 10, 20), ("gone", "deleted", 20, 30), ("gone", "inserted", 30, None), ("void", "inserted", 20, 30), ("void", "deleted", 30, None)}
    assert got == want
