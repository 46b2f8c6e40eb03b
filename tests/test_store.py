"""The store from writing client to lookup, as a user of it would go."""

import gzip
import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spoolwright import cli, codec
from spoolwright.operators.segments import roll_segments
from spoolwright.operators.store import LogStore, StoreError, as_json, get_across
from spoolwright.schema import parse_id_literal
from spoolwright.sources import files
from spoolwright.sources.client import LogWriterClient, SavedDataSource
from spoolwright.storage import Lease, Manifest
from spoolwright.streaming.ingest import convert, update

INFO = "Some user-related very important information "
LOGS = [
    ("user", "user-1", 10, INFO + "1"),
    ("user", "user-1", 20, INFO + "5678"),
    ("user", "user-1", 30, INFO + "73"),
    ("user", "user-2", 40, INFO + "-----#"),
    ("user", "user-2", 50, INFO + "961"),
    ("user", "user-2", 50, INFO + "961"),
    ("user", "user-1", 10, INFO + "1"),
    ("event", 37377, 60, "EVENT!"),
    ("event", 37377, 70, "WOW! MORE EVENTS"),
]


def data(df):
    return [bytes(r["data"]).decode() for r in df.collect()]


def test_end_to_end(spark, tmp_path):
    spool, db = tmp_path / "spool", f"file://{tmp_path}/db"
    with LogWriterClient(spool) as w:
        for r in LOGS:
            w.append(*r)
    assert [p.suffix for p in spool.iterdir()] == [".saved"]
    s = LogStore(spark, db)
    assert update(s, f"file://{spool}") == {"seen": 9, "added": 7, "duplicates": 2}
    assert list(spool.rglob("*.saved")) == []
    for _ in range(2):
        assert data(s.get("user", "user-1")) == [INFO + x for x in ("1", "5678", "73")]
        assert data(s.get("user", "user-2")) == [INFO + x for x in ("-----#", "961")]
        assert data(s.get("event", 37377)) == ["EVENT!", "WOW! MORE EVENTS"]
        assert data(s.get("event", "37377")) == [] == data(s.get("nothing", 1))
        s.archive()
    assert [(r.name, r.read_only, r.records, r.hashes, r.min_timestamp, r.max_timestamp) for r in s.info().collect()] == [("001.record.gz", True, 7, 7, 10, 70)]
    # what is read again adds nothing; what is new begins a new segment
    with LogWriterClient(spool) as w:
        for r in [*LOGS, ("user", None, 5, "an old one without identifier")]:
            w.append(*r)
    assert update(s, f"file://{spool}") == {"seen": 10, "added": 1, "duplicates": 9}
    assert [r.name for r in s.info().collect()] == ["001.record.gz", "002.record"]
    assert data(s.get("user", None)) == ["an old one without identifier"]
    assert s.archive() == [2] and s.archive() == []
    assert all(r.ok for r in s.fsck().collect())


FIVE = [(55, "user", 1, "some data"), (61, "user", 1, "another data"), (43, "user", 2, "second user"), (80, "account", 5, "some account"), (85, "account", 5, "another 5 account")]


def frame(spark, rows, start=0):
    return spark.createDataFrame([(t, 1, i, None, ts, d.encode(), n) for n, (ts, t, i, d) in enumerate(rows, start)], "table_name string, id_kind tinyint, id_int int, id_str string, timestamp bigint, data binary, pos bigint")


def test_segments_roll(spark, tmp_path):
    s = LogStore(spark, f"file://{tmp_path}/db", max_records=2)
    assert s.add_records(frame(spark, FIVE[:4]), ["pos"])["added"] == 4
    assert s.add_records(frame(spark, [FIVE[0], FIVE[1], FIVE[3], FIVE[4]]), ["pos"]) == {"seen": 4, "added": 1, "duplicates": 3}
    assert [(r.name, r.records, r.read_only) for r in s.info().collect()] == [("001.record", 2, True), ("002.record", 2, True), ("003.record", 1, False)]
    assert data(s.get("user", 1)) == ["some data", "another data"]
    assert data(s.get("account", 5)) == ["some account", "another 5 account"]
    assert data(s.get("account", 1)) == []
    keys = spark.createDataFrame([("user", "i:2"), ("account", "i:5"), ("account", "i:5")], "table_name string, id_key string")
    assert sorted(data(s.get_many(keys))) == ["another 5 account", "second user", "some account"]


def test_rolling_by_bytes(spark):
    df = frame(spark, [(1, "t", 1, "x" * n) for n in (10, 10, 500, 10, 10, 10, 700)])
    got = [r.segment for r in roll_segments(df, ["pos"], 3, 64 + 100).orderBy("n").collect()]
    assert got == [1, 1, 2, 3, 3, 3, 4]
    got = [r.segment for r in roll_segments(df, ["pos"], 3, 64 + 100, 7, 2, 64 + 90).orderBy("n").collect()]
    assert got == [8, 8, 9, 10, 10, 10, 11]


def test_lookup_is_pruned(spark, tmp_path):
    s = LogStore(spark, f"file://{tmp_path}/db")
    s.add_records(frame(spark, FIVE), ["pos"])
    plan = s.get("user", 1)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(table_name,user)" in plan and "EqualTo(id_key,i:1)" in plan


def test_damaged_statistics_are_made_anew(spark, tmp_path):
    s = LogStore(spark, f"file://{tmp_path}/db", max_records=2)
    s.add_records(frame(spark, FIVE[:3]), ["pos"])
    state = s._manifest.read()
    state["segments"][1] |= {"records": 7, "days": []}
    s._manifest.write(state)
    assert [r.ok for r in s.fsck().orderBy("segment").collect()] == [True, False]
    assert s.rebuild() == 3
    assert s.add_records(frame(spark, FIVE), ["pos"]) == {"seen": 5, "added": 2, "duplicates": 3}
    assert all(r.ok for r in s.fsck().collect()) and s.records().count() == 5


class Died(Exception):
    pass


@pytest.mark.parametrize("what", ["add", "archive"])
@pytest.mark.parametrize("at", ["written", "checked", "named"])
def test_writer_dies(spark, tmp_path, monkeypatch, what, at):
    """A writer that ends behind each step leaves the store as it was, or as it was to be; what comes next goes on."""
    s = LogStore(spark, f"file://{tmp_path}/db", max_records=2)
    s.add_records(frame(spark, FIVE[:3]), ["pos"])
    with monkeypatch.context() as m:
        if at == "named":  # the manifest is there, what follows isn't
            write = Manifest.write
            m.setattr(Manifest, "write", lambda self, state: (write(self, state), (_ for _ in ()).throw(Died()))[1])
        elif at == "checked":
            m.setattr(Manifest, "write", lambda self, state: (_ for _ in ()).throw(Died()))
        else:
            m.setattr(LogStore, "_commit", lambda self, lease, state: (_ for _ in ()).throw(Died()))
        m.setattr(Lease, "release", lambda self: self._done.set())  # nor is the lock given back
        with pytest.raises(Died):
            s.add_records(frame(spark, FIVE), ["pos"]) if what == "add" else s.archive()
    assert (tmp_path / "db" / "db.lock").exists()
    s = LogStore(spark, f"file://{tmp_path}/db", max_records=2, lock_wait=0.1)
    assert s.records().count() == (5 if what == "add" and at == "named" else 3) and all(r.ok for r in s.fsck().collect())
    with pytest.raises(StoreError, match="in use"):
        s.add_records(frame(spark, FIVE), ["pos"])
    s.lease, s.lock_wait = 0.0, 5.0  # its lease has run out
    assert s.add_records(frame(spark, FIVE), ["pos"])["added"] == (0 if what == "add" and at == "named" else 2)
    s.lease = 60.0
    assert sorted(data(s.records())) == sorted(d for *_, d in FIVE) and all(r.ok for r in s.fsck().collect())
    s.archive()
    s.archive()
    assert s.add_records(frame(spark, FIVE), ["pos"])["added"] == 0 and s.records().count() == 5
    # what broke off or was replaced is gone
    folders = [p for p in (tmp_path / "db" / "records").iterdir() if p.name.startswith("write=")]
    assert {p.name.removeprefix("write=") for p in folders} <= set(s._manifest.read()["writes"])


def test_lost_manifest(spark, tmp_path):
    s = LogStore(spark, f"file://{tmp_path}/db", max_records=2)
    s.add_records(frame(spark, FIVE[:3]), ["pos"])
    s.archive()  # the segments as they were are still there
    s.add_records(frame(spark, FIVE), ["pos"])
    for p in (tmp_path / "db" / "manifest").iterdir():
        p.unlink()
    with pytest.raises(StoreError, match="rebuild"):
        s.add_records(frame(spark, FIVE), ["pos"])
    assert s.rebuild() == 5 and s.records().count() == 5 and all(r.ok for r in s.fsck().collect())
    assert s.add_records(frame(spark, FIVE), ["pos"])["added"] == 0


def test_a_late_record_reads_its_day_alone(spark, tmp_path):
    s = LogStore(spark, f"file://{tmp_path}/db", max_records=10)
    day = 86_400_000
    for d in range(6):  # a segment a day
        s.add_records(frame(spark, [(d * day + i, "t", 1, f"{d}-{i}") for i in range(10)]), ["pos"])
    late = [(5 * day + 99, "t", 1, "new"), (3, "t", 1, "0-3"), (None, "t", 1, "no time")]
    assert s.add_records(frame(spark, late), ["pos"])["added"] == 2
    stored = s._stored(s._state(), [0, 5])
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert stored.count() == 21 and "Or(And(GreaterThanOrEqual(timestamp,0)" in plan and "segment" in plan.split("PartitionFilters")[1]
    assert s.add_records(frame(spark, late), ["pos"])["added"] == 0


def test_temporary_tables_are_removed(spark, tmp_path):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "spoolwright"
    before = set(shared.iterdir()) if shared.exists() else set()
    LogStore(spark, f"file://{tmp_path}/db").add_records(frame(spark, FIVE), ["pos"])
    assert set(shared.iterdir()) == before


def test_files_that_stay_are_read_once(spark, tmp_path):
    spool = tmp_path / "spool"
    s = LogStore(spark, f"file://{tmp_path}/db")
    for k in (1, 2):
        with LogWriterClient(spool) as w:
            w.append("t", k, k, "x")
        assert update(s, f"file://{spool}", delete=False) == {"seen": 1, "added": 1, "duplicates": 0}
    assert update(s, f"file://{spool}", delete=False)["seen"] == 0


def test_missing_store_and_lock(spark, tmp_path):
    s = LogStore(spark, f"file://{tmp_path}/none")
    with pytest.raises(StoreError):
        s.get("a", 1)
    assert s.info().collect() == [] and (tmp_path / "none").exists()
    (tmp_path / "none" / "db.lock").touch()  # young, so its holder may be alive
    s.lock_wait = 0.1
    with pytest.raises(StoreError, match="in use"):
        s.add_records(frame(spark, FIVE), ["pos"])
    (tmp_path / "none" / "db.lock").unlink()
    assert s.add_records(frame(spark, []), ["pos"]) == {"seen": 0, "added": 0, "duplicates": 0}


def test_bad_file_fails_its_batch(spark, tmp_path):
    spool = tmp_path / "spool"
    with LogWriterClient(spool) as w:
        w.append("t", 1, 1, "x")
    (spool / "bad.saved").write_bytes(b"\0\0\0\1")
    s = LogStore(spark, f"file://{tmp_path}/db")
    with pytest.raises(Exception, match="bad.saved"):
        update(s, f"file://{spool}")
    assert len(list(spool.glob("*.saved"))) == 2 and s.records().count() == 0
    good, bad = files.quarantine(files.read_saved(spark, f"file://{spool}", strict=False))
    assert data(good) == ["x"] and "version 1" in bad.first().error


def test_walk_is_recursive_and_by_suffix(spark, tmp_path):
    b = codec.saved_file([("t", 1, 1, None, 5, b"x")])
    for p, c in {"b/1.saved": b, "a/2.saved.gz": gzip.compress(b), "a/3.SAVED": b"?", "c/current": b"?", "d/4.saved.tmp": b"?"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(c)
    got = files.read_saved(spark, f"file://{tmp_path}").orderBy("path", "pos").collect()
    assert [r.path.rpartition("/")[2] for r in got] == ["2.saved.gz", "1.saved"]


def test_client(tmp_path):
    now = [1000.0]
    w = LogWriterClient(tmp_path, lifetime_ms=5000, clock=lambda: now[0])
    (tmp_path / "current-999999999").write_bytes(codec.saved_file([("lost", 0, None, None, 1, b"x")]))
    w.append("t", 1, 1, "a")
    assert len(list(tmp_path.glob("*.saved"))) == 1  # the one left behind
    now[0] += 4
    w.append("t", "s", 2, "b")
    assert len(list(tmp_path.glob("*.saved"))) == 1
    now[0] += 1
    w.append("t", None, 3, "c")  # the first is too old now
    w.close()
    w.close()
    names = sorted(p.name for p in tmp_path.iterdir())
    stamp = lambda t: datetime.fromtimestamp(t).strftime("%Y%m%dT%H%M%S")
    assert names == sorted([f"{stamp(1000)}.saved", f"{stamp(1005)}.saved", f"{stamp(1005)}-1.saved"])
    rows = [r for n in names for r in codec.read_saved((tmp_path / n).read_bytes())]
    assert sorted(r[5] for r in rows) == [b"a", b"b", b"c", b"x"]


def test_data_source(spark, tmp_path):
    spark.dataSource.register(SavedDataSource)
    at = str(tmp_path / "out")
    df = frame(spark, FIVE).drop("pos").repartition(2)
    df.write.format("saved").mode("append").save(at)
    assert [p.suffix for p in Path(at).iterdir()] == [".saved"] * 2
    assert sorted(spark.read.format("saved").load(at).collect()) == sorted(df.collect())
    with pytest.raises(Exception, match="mounted folders"):
        df.write.format("saved").mode("append").save("hdfs://host/out")


def test_legacy(spark, tmp_path):
    text = "---- 2015-04-01 12:00:00 id:1\nfoo\n\n---- 2015-04-01 12:00:01\nbar id:7\n\n---- oneline"
    (tmp_path / "user.sql.01").write_bytes(text.encode())
    (tmp_path / "a.sql.b.sql.02.gz").write_bytes(gzip.compress("---- 2015-04-01 12:00:02 id:2\nтест".encode("cp1251")))
    (tmp_path / "empty.sql.1").touch()
    (tmp_path / "other.txt").write_text("x\ny")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.sql.1").write_bytes(text.encode())
    rows = files.read_legacy(spark, f"file://{tmp_path}").orderBy("path", "pos").collect()
    day = 1427889600000
    assert [(r.table_name, r.id_key, r.timestamp, bytes(r.data).decode()) for r in rows] == [
        ("a.sql.b", "i:2", day + 2000, "---- 2015-04-01 12:00:02 id:2\nтест"),
        ("user", "i:1", day, "---- 2015-04-01 12:00:00 id:1\nfoo"),
        ("user", "", day + 1000, "---- 2015-04-01 12:00:01\nbar id:7"),
    ]
    s = LogStore(spark, f"file://{tmp_path}/db")
    assert convert(s, files.read_legacy(spark, f"file://{tmp_path}"))["added"] == 3
    assert (tmp_path / "user.sql.01").exists()
    assert [f.rpartition("/")[2] for f in files.year_folders(spark, f"file://{tmp_path}")] == ["db", "sub"]


def test_segment_files(spark, tmp_path):
    recs = [("t", 2, None, "a", 5, b"x"), ("t", 0, None, None, 6, b"y")]
    b = codec.segment_file(recs)
    (tmp_path / "001.record.gz").write_bytes(gzip.compress(b))
    (tmp_path / "002.record").write_bytes(b[:-1])
    got = files.read_segments(spark, f"file://{tmp_path}").orderBy("path", "pos").collect()
    assert [(r.pos, r.id_key, r.timestamp, bytes(r.data)) for r in got] == [(64, "s:a", 5, b"x"), (64 + 16 - 1, "", 6, b"y"), (64, "s:a", 5, b"x")]


def test_across_and_json(spark, tmp_path):
    stores = []
    for year, rows in (("2015", [(9, "t", 1, "late"), (5, "t", 1, "five, first store")]), ("2016", [(5, "t", 1, "five, second store"), (1, "t", 1, "early")])):
        s = LogStore(spark, f"file://{tmp_path}/{year}")
        s.add_records(frame(spark, rows), ["pos"])
        stores.append(s)
    assert data(get_across(stores, "t", "1")) == ["early", "five, first store", "five, second store", "late"]
    df = spark.createDataFrame(
        [("t", 0, None, None, 1, b"\xd1\x8f"), ("t", 1, 5, None, 2, b'"q"'), ("t", 2, None, '5 "x"\n', 3, b"")],
        "table_name string, id_kind tinyint, id_int int, id_str string, timestamp bigint, data binary",
    )
    got = [json.loads(r.json) for r in as_json(df).orderBy("timestamp").collect()]
    assert got == [
        {"timestamp": 1, "tableName": "t", "id": None, "data": "я"},
        {"timestamp": 2, "tableName": "t", "id": 5, "data": '"q"'},
        {"timestamp": 3, "tableName": "t", "id": '5 "x"\n', "data": ""},
    ]


def test_typed_ids():
    assert [parse_id_literal(s) for s in ("007", "+5", "-5", " 5", "5.0", "3000000000", "", "abc", "-2147483648")] == ["i:7", "i:5", "i:-5", "s: 5", "s:5.0", "s:3000000000", "s:", "s:abc", "i:-2147483648"]


def test_cli(spark, tmp_path, capsys):
    spool, db = tmp_path / "spool", f"file://{tmp_path}/db"
    with LogWriterClient(spool) as w:
        for r in LOGS:
            w.append(*r)
    assert cli.main(["update", db, f"file://{spool}"], spark) == 0
    capsys.readouterr()
    assert cli.main(["get", db, "event", "37377"], spark) == 0
    assert [r["timestamp"] for r in json.loads(capsys.readouterr().out)] == [60, 70]
    assert cli.main(["info", db], spark) == 0
    out = capsys.readouterr().out
    assert out == "001.record: r/o:0 v:2 records:7 headers:7 hashes:7 minTS:70-01-01_00:00:00 maxTS:70-01-01_00:00:00\nTotal storages: 1\n"
    assert cli.main(["archive", db], spark) == 0
    assert cli.main(["get", f"file://{tmp_path}/nowhere", "a", "1"], spark) == 1
    for bad in ([], ["get", db], ["what", db]):
        with pytest.raises(SystemExit) as e:
            cli.main(bad, spark)
        assert e.value.code == 255
