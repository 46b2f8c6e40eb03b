"""The store: append-only, deduplicating, keyed log records in Parquet.

``records/write=W/segment=N`` holds what a write put into a segment, sorted by table and identifier, with statistics and
bloom filters for point lookups. A manifest tells which of these folders make up each segment, and each segment's
statistics. A write goes to a folder of its own and counts from the one rename on that puts a new manifest in place; if
it breaks off anywhere before, readers and later writers see what was there, and the next writer removes what is left
of it. There is no other index. Reading takes no lock, writing takes a lease.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import digest
from ..schema import IDENTITY, LOG_SCHEMA, RECORD_SCHEMA, parse_id_literal, with_id_key
from ..session import BROADCAST_ROWS, broadcast_if_small, materialise, scratch
from ..storage import Lease, Manifest
from ..storage import fs_of as _fs
from . import segments as seg
from .compaction import VerificationError, _write_checked
from .deliveries import first_deliveries


class StoreError(RuntimeError):
    """What a person should be told: a missing store, one in use, one that is not whole."""


#: Stored beside the record: ``digest`` of its identity, so that finding duplicates reads 16 bytes of a record.
STORED = T.StructType([f for f in LOG_SCHEMA.fields if f.name != "segment"] + [T.StructField("digest", T.BinaryType()), LOG_SCHEMA["segment"]])

SEGMENTS = "segment int, read_only boolean, archived boolean, head_version int, records bigint, hashes bigint, min_timestamp bigint, max_timestamp bigint, total_bytes bigint"


_COLUMNS = [c.split()[0] for c in SEGMENTS.split(", ")]
DAY = 86_400_000
#: The day of records without a time.
NO_DAY = -(2**31)
#: Runs of days up to which they are pushed to the scan as ranges of time.
RANGES = 200


def _day():
    return F.coalesce(F.floor(F.col("timestamp") / DAY), F.lit(NO_DAY)).cast("bigint")


def _of_days(days: list[int]):
    """A filter for records of some days: ranges of time, which the scan can use, and the days themselves."""
    runs: list[list[int]] = []
    for d in sorted(days):
        if d == NO_DAY:
            continue
        if runs and runs[-1][1] + 1 == d:
            runs[-1][1] = d
        else:
            runs.append([d, d])
    at = F.col("timestamp")
    where = [(at >= a * DAY) & (at < (b + 1) * DAY) for a, b in runs]
    if len(where) > RANGES:
        where = [_day().isin([d for d in days if d != NO_DAY])]
    if NO_DAY in days:
        where.append(at.isNull())
    return reduce(lambda x, y: x | y, where)


def _no_stats(segment: int) -> dict:
    return {
        "segment": segment, "read_only": False, "archived": False, "head_version": seg.VERSION, "records": 0, "hashes": 0,
        "min_timestamp": seg.NO_MIN, "max_timestamp": seg.NO_MAX, "total_bytes": 0, "days": [], "writes": [],
    }


def identity_digest():
    """Digest of what makes two records the same."""
    return digest(F.col("table_name"), F.col("id_key"), F.col("timestamp"), F.hex("data"))


class LogStore:
    def __init__(
        self, spark: SparkSession, path: str, max_records: int = seg.MAX_RECORDS, max_bytes: int = seg.MAX_BYTES, lock_wait: float = 60.0, lease: float = 120.0
    ):
        """A writer waits ``lock_wait`` seconds for another one; a lock whose holder hasn't been heard of for ``lease``
        seconds is taken over."""
        self.spark, self.path = spark, path.rstrip("/")
        self.max_records, self.max_bytes, self.lock_wait, self.lease = max_records, max_bytes, lock_wait, lease
        self._manifest = Manifest(spark, f"{self.path}/manifest")

    # -- places

    def _exists(self, what: str) -> bool:
        fs, p = _fs(self.spark, f"{self.path}/{what}")
        return fs.exists(p)

    def create(self) -> None:
        fs, p = _fs(self.spark, self.path)
        fs.mkdirs(p)

    def _lock(self) -> Lease:
        self.create()
        lease = Lease(self.spark, f"{self.path}/db.lock", self.lease)
        if not lease.take(self.lock_wait):
            raise StoreError(f"{self.path} is in use: {lease.path}")
        return lease

    def _state(self) -> dict:
        """``segments``: statistics by segment, with the ``days`` its records are of and the ``writes`` that hold them;
        ``writes``: the segments that each write went to; ``old``: writes that nothing refers to any more."""
        state = self._manifest.read()
        if state is None:
            if self._exists("records"):
                raise StoreError(f"{self.path} has records and no manifest; rebuild it")
            state = {"segments": [], "writes": {}, "old": []}
        return state

    def _read(self, state: dict) -> DataFrame:
        live: dict[str, set[int]] = {}
        for r in state["segments"]:
            for w in r["writes"]:
                live.setdefault(w, set()).add(r["segment"])
        if not live:
            return self.spark.createDataFrame([], STORED)
        at = f"{self.path}/records"
        schema = T.StructType([*STORED.fields, T.StructField("write", T.StringType())])
        rows = self.spark.read.schema(schema).option("basePath", at).parquet(*[f"{at}/write={w}" for w in sorted(live)])
        for w, segments in live.items():
            if segments != set(state["writes"][w]):  # others of it were written anew
                rows = rows.where((F.col("write") != w) | F.col("segment").isin(sorted(segments)))
        return rows.drop("write")

    def records(self) -> DataFrame:
        return self._read(self._state())

    def segments(self) -> DataFrame:
        rows = [tuple(r[c] for c in _COLUMNS) for r in self._state()["segments"]]  # a row for each segment of up to 2 GB
        return self.spark.createDataFrame(rows, SEGMENTS)

    # -- writing

    def _begin(self, lease: Lease) -> dict:
        """The state to go on from. Removes what writes that broke off have left, and what was replaced a write ago."""
        lease.check()
        state = self._state()
        fs, p = _fs(self.spark, f"{self.path}/records")
        if fs.exists(p):
            for f in fs.listStatus(p):
                if f.getPath().getName().removeprefix("write=") not in state["writes"]:
                    fs.delete(f.getPath(), True)
        return state

    def _commit(self, lease: Lease, state: dict) -> None:
        live = {w for r in state["segments"] for w in r["writes"]}
        # what is replaced stays for readers until the write after this one
        state["writes"] = {w: s for w, s in state["writes"].items() if w not in state["old"]}
        state["old"] = [w for w in state["writes"] if w not in live]
        state["segments"].sort(key=lambda r: r["segment"])
        lease.check()
        self._manifest.write(state)

    def add_records(self, batch: DataFrame, order: Sequence[str] = ("path", "pos")) -> dict[str, int]:
        """Adds what is new, in the order of ``order``; gives counts of seen, added and duplicates. Of equal records
        the first counts; equal are those with the same table, identifier, time and data."""
        lease = self._lock()
        try:
            with scratch(self.spark):
                return self._add(batch, list(order), lease)
        finally:
            lease.release()

    def _add(self, batch: DataFrame, order: list[str], lease: Lease) -> dict[str, int]:
        state = self._begin(lease)
        batch = with_id_key(batch).withColumn("digest", identity_digest())
        cols = [f.name for f in RECORD_SCHEMA.fields] + ["id_key", "digest"]
        batch = materialise(batch.select(*cols, *order), "batch")
        per_day = {r[0]: r[1] for r in batch.groupBy(_day()).agg(F.count(F.lit(1))).collect()}  # a row for each day
        seen = sum(per_day.values())
        if not seen:
            return {"seen": 0, "added": 0, "duplicates": 0}
        known = {r["segment"]: r for r in state["segments"]}
        first = first_deliveries(batch, ["digest"], F.col(order[0]), [F.col(c) for c in order[1:]], [*cols, *order])
        first = self._unknown(materialise(first, "first"), state, sorted(per_day), seen <= BROADCAST_ROWS)
        last = known[max(known)] if known else None
        at, n, b = (1, 0, seg.HEAD_BYTES) if last is None else (last["segment"], last["records"], last["total_bytes"] + seg.HEAD_BYTES)
        if last and (last["read_only"] or last["archived"] or n >= self.max_records):
            at, n, b = last["segment"] + 1, 0, seg.HEAD_BYTES
        rows = seg.roll_segments(first, order, self.max_records, self.max_bytes, at, n, b)
        start = sum(s["records"] for s in known.values())
        # a row for each segment that gets something
        new = rows.groupBy("segment").agg(F.count(F.lit(1)), F.min("timestamp"), F.max("timestamp"), F.sum("size"), F.collect_set(_day())).collect()
        if new:
            write = f"w{uuid.uuid4().hex}"
            out = rows.withColumn("seq", F.col("n") + start).select(*[f.name for f in STORED.fields])
            # a segment is at most as large as one task's file may be; sorted for pruning by table and identifier
            w = out.repartition("segment").sortWithinPartitions("table_name", "id_key", "seq").write.partitionBy("segment")
            # ids of high cardinality get a bloom filter; a dictionary would keep it from being written
            w.option("parquet.bloom.filter.enabled#id_key", "true").option("parquet.enable.dictionary#id_key", "false").parquet(f"{self.path}/records/write={write}")
            for n, k, lo, hi, size, days in new:
                s = known.setdefault(n, _no_stats(n))
                s["records"] += k
                s["hashes"] += k  # all records are distinct: what isn't was left out
                if lo is not None:
                    s["min_timestamp"], s["max_timestamp"] = min(s["min_timestamp"], lo), hi if s["min_timestamp"] == seg.NO_MIN else max(s["max_timestamp"], hi)
                s["total_bytes"] += size
                s["read_only"] = s["records"] >= self.max_records
                s["days"] = sorted({*s["days"], *days})
                s["writes"] = [*s["writes"], write]
            state["segments"] = list(known.values())
            state["writes"][write] = [r[0] for r in new]
            self._commit(lease, state)
        added = sum(r[1] for r in new)
        return {"seen": seen, "added": added, "duplicates": seen - added}

    def _stored(self, state: dict, days: list[int]) -> DataFrame:
        """Digests of the stored records of some days. Equal records are of the same day, so only segments with records
        of the batch's days are read, whatever lies between them: a late record adds its day alone."""
        asked = set(days)
        meet = [r["segment"] for r in state["segments"] if not asked.isdisjoint(r["days"])]
        return self._read(state).where(F.col("segment").isin(meet) & _of_days(days)).select("digest")

    def _unknown(self, first: DataFrame, state: dict, days: list[int], small: bool) -> DataFrame:
        """Records that the store lacks. What it has is narrowed down to the batch's before anything else; a small batch's
        digests go to where the store lies."""
        asked = set(days)
        if all(asked.isdisjoint(r["days"]) for r in state["segments"]):
            return first
        mine = first.select("digest")
        again = self._stored(state, days).join(F.broadcast(mine) if small else mine, "digest", "left_semi")
        return first.join(again, "digest", "left_anti")

    # -- reading

    def get(self, table: str, id: int | str | None) -> DataFrame:
        """Records of a table and identifier in the order they were stored. An int and the same digits as a string are
        different; None is the empty identifier."""
        return self.get_key(table, "" if id is None else f"i:{id}" if isinstance(id, int) else f"s:{id}")

    def get_typed(self, table: str, typed: str) -> DataFrame:
        """``get`` with an identifier as a person types it: an int if it can be one."""
        return self.get_key(table, parse_id_literal(typed))

    def get_key(self, table: str, id_key: str) -> DataFrame:
        self._must_hold_something()
        found = self.records().where((F.col("table_name") == table) & (F.col("id_key") == id_key))
        return found.orderBy("segment", "seq").select(*[f.name for f in LOG_SCHEMA.fields])

    def get_many(self, keys: DataFrame) -> DataFrame:
        """Records of all ``table_name, id_key`` in ``keys``."""
        self._must_hold_something()
        return self.records().join(broadcast_if_small(keys.distinct()), ["table_name", "id_key"], "left_semi")

    def _must_hold_something(self) -> None:
        if not self._exists("records"):
            raise StoreError(f"no records in {self.path}")

    def info(self) -> DataFrame:
        """A row for each segment, in order of name, from the statistics alone."""
        self.create()
        suffix = F.when(F.col("archived"), ".record.gz").otherwise(".record")
        return self.segments().select(
            F.concat(seg.segment_name(F.col("segment"), ""), suffix).alias("name"), "read_only", "head_version", "records",
            F.col("records").alias("headers"), "hashes", "min_timestamp", "max_timestamp",
        ).orderBy("name")

    def fsck(self) -> DataFrame:
        """Statistics against records: ``ok`` for each segment that either knows."""
        real = self.records().groupBy("segment").agg(
            F.count(F.lit(1)).alias("real_records"), F.min("timestamp").alias("real_min"), F.max("timestamp").alias("real_max")
        )
        both = self.segments().join(real, "segment", "full_outer")
        same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("records", "real_records"), ("min_timestamp", "real_min"), ("max_timestamp", "real_max"))]
        return both.select("segment", "records", "real_records", (same[0] & same[1] & same[2]).alias("ok"))

    # -- upkeep

    def archive(self, compression: str = "gzip") -> list[int]:
        """Rewrites each segment that isn't archived with a stronger compression and compares; all replace the old ones
        at once. Later records begin a new segment. Gives the segments."""
        lease = self._lock()
        try:
            state = self._begin(lease)
            todo = sorted(r["segment"] for r in state["segments"] if not r["archived"])
            if todo:
                self._rewrite(lease, state, todo, compression)
            return todo
        finally:
            lease.release()

    def _rewrite(self, lease: Lease, state: dict, todo: list[int], compression: str) -> None:
        write = f"w{uuid.uuid4().hex}"
        for n in todo:
            at = f"{self.path}/records/write={write}/segment={n}"
            rows = self._read(state).where(F.col("segment") == n).drop("segment")
            schema = rows.schema

            def put(d: DataFrame, at: str = at) -> None:
                d.coalesce(1).sortWithinPartitions("table_name", "id_key", "seq").write.option("compression", compression).parquet(at)

            try:
                _write_checked(rows, lambda at=at, schema=schema: self.spark.read.schema(schema).parquet(at), put, f"segment {n}")
            except VerificationError as e:
                raise StoreError(str(e)) from e
        for r in state["segments"]:
            if r["segment"] in todo:
                r["archived"], r["read_only"], r["writes"] = True, True, [write]
        state["writes"][write] = todo
        self._commit(lease, state)

    def rebuild(self) -> int:
        """Makes statistics anew from the records; without a manifest, the store from all folders of records that were
        written to their end: of what is in several, as after archiving, one is kept. Gives the number of records."""
        lease = self._lock()
        try:
            fs, p = _fs(self.spark, f"{self.path}/records")
            if self._manifest.versions():
                state = self._begin(lease)
                kept = {r["segment"]: r for r in state["segments"]}
                rows = self._read(state)
            elif fs.exists(p):
                whole = [f.getPath().toString() for f in fs.listStatus(p) if fs.exists(_fs(self.spark, f"{f.getPath()}/_SUCCESS")[1]) or any(fs.exists(_fs(self.spark, f"{g.getPath()}/_SUCCESS")[1]) for g in fs.listStatus(f.getPath()))]
                state, kept, write = {"segments": [], "writes": {}, "old": []}, {}, f"w{uuid.uuid4().hex}"
                read = [self.spark.read.schema(STORED).parquet(w) for w in whole]
                rows = reduce(DataFrame.unionByName, read) if read else self.spark.createDataFrame([], STORED)
                names = [f.name for f in STORED.fields]
                rows = first_deliveries(rows, ["digest"], F.col("seq"), [], names)
                out = rows.repartition("segment").sortWithinPartitions("table_name", "id_key", "seq")
                out.write.partitionBy("segment").parquet(f"{self.path}/records/write={write}")
                rows = self.spark.read.schema(STORED).parquet(f"{self.path}/records/write={write}")
            else:
                return 0
            days = rows.groupBy("segment").agg(F.collect_set(_day()).alias("days"))
            found = [r.asDict() for r in seg.stats(rows).join(days, "segment").collect()]  # a row for each segment
            if not self._manifest.versions():
                state["writes"] = {write: [r["segment"] for r in found]}
            state["segments"] = []
            for r in found:
                old = kept.get(r["segment"], _no_stats(r["segment"]) | {"writes": list(state["writes"])})
                full = old["archived"] or r["records"] >= self.max_records
                times = {k: v for k, v in r.items() if v is not None}
                state["segments"].append(old | times | {"read_only": full, "days": sorted(r["days"])})
            self._commit(lease, state)
            return sum(r["records"] for r in found)
        finally:
            lease.release()


def appendable(segments: DataFrame) -> DataFrame:
    """Segments that may still be written to."""
    return segments.where(~F.col("archived") & ~F.col("read_only"))


def get_across(stores: Iterable[LogStore], table: str, typed: str) -> DataFrame:
    """Records of several stores (years), by time; of equal times in the order of stores, segments and arrival. Nothing
    is deduplicated across stores."""
    found = [s.get_typed(table, typed).withColumn("db_ord", F.lit(i)) for i, s in enumerate(stores)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.orderBy("timestamp", "db_ord", "segment", "seq")


def as_json(records: DataFrame) -> DataFrame:
    """``json``: timestamp, tableName, id (number, text or null) and data as text of each record, nulls kept."""
    ident = F.when(F.col("id_kind") == 1, F.to_json(F.struct(F.col("id_int").alias("v")))).when(F.col("id_kind") == 2, F.to_json(F.struct(F.col("id_str").alias("v"))))
    variant = F.coalesce(F.parse_json(F.get(F.regexp_extract_all(ident, F.lit(r'(?s)^\{"v":(.*)\}$'), F.lit(1)), F.lit(0))), F.parse_json(F.lit("null")))
    return records.withColumn(
        "json", F.to_json(F.struct("timestamp", F.col("table_name").alias("tableName"), variant.alias("id"), F.col("data").cast("string").alias("data")))
    )
