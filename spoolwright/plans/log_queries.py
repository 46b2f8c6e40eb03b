"""Queries of the log store's operators, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import arrays
from ..functions import dates, hashing, ints, strings
from ..functions.text import log_text
from ..operators import segments as seg
from ..operators.deliveries import first_deliveries
from ..operators.store import LogStore, appendable, as_json, get_across
from ..schema import IDENTITY, parse_id
from ..session import fresh_path, materialise, table
from ..storage import fs_of as _fs
from ..sources import client, files
from ..streaming.ingest import added_and_duplicates, convert, update
from . import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Records in a segment of the queries.
N = 2000
EVENTS = """(SELECT event_id AS seq, event_type AS table_name, user_id::INT AS id_int, 'i:' || user_id AS id_key,
epoch_us(ts) // 1000 AS timestamp, props AS data, ((event_id - (SELECT min(event_id) FROM events)) // 2000 + 1)::INT AS segment FROM events)"""
#: Every tenth event is delivered again.
REPLAY = f"(SELECT * FROM {EVENTS} UNION ALL SELECT * FROM {EVENTS} WHERE seq % 10 = 0)"
ID_KEY = "CASE id_kind WHEN 1 THEN 'i:' || id_int WHEN 2 THEN 's:' || id_str ELSE '' END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in segments of N records. Their numbers are dense, so a record's segment follows from its own."""
    e = adapters.events(spark, sf_dir)
    low = e.agg(F.min("seq")).first()[0] or 0
    return e.withColumn("segment", seg.segment_of(F.col("seq") - low, N))


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.events(spark, sf_dir)
    return e.unionByName(e.where(F.col("seq") % 10 == 0))


SHOWN = ["table_name", "id_key", "timestamp", "cast(data as string) as data"]
SHOWN_SQL = "table_name, id_key, timestamp, data"

# ---- lookups


@query(f"SELECT {SHOWN_SQL} FROM {EVENTS} WHERE table_name = 'purchase' AND id_key = 'i:12'")
def get_point(spark, sf_dir):
    return adapters.events(spark, sf_dir, "purchase", 12).orderBy("timestamp", "seq").selectExpr(*SHOWN)


@query(f"SELECT {SHOWN_SQL} FROM {EVENTS} WHERE (table_name, id_key) IN (SELECT (table_name, id_key) FROM {EVENTS} WHERE seq % 100 = 0)")
def get_many(spark, sf_dir):
    """All records of the keys of every hundredth event."""
    e = adapters.events(spark, sf_dir)
    return e.join(e.where(F.col("seq") % 100 == 0).select("table_name", "id_key").distinct(), ["table_name", "id_key"], "left_semi").selectExpr(*SHOWN)


@query(f"""SELECT timestamp, data, CASE WHEN timestamp < 1705276800000 THEN 0 ELSE 1 END AS db_ord FROM {EVENTS}
WHERE table_name = 'click' AND id_key = 'i:3'""")
def get_multi_db(spark, sf_dir):
    """One identifier in two stores, merged by time."""
    e = materialise(adapters.events(spark, sf_dir), "events")
    stores = []
    for half in (F.col("timestamp") < 1705276800000, F.col("timestamp") >= 1705276800000):
        s = LogStore(spark, fresh_path(spark, "year"), max_records=50_000)
        s.add_records(e.where(half), ["seq"])
        stores.append(s)
    return get_across(stores, "click", "3").select("timestamp", F.col("data").cast("string").alias("data"), "db_ord")


@query(f"""SELECT seq, {ID_KEY} AS id_key, ts AS timestamp FROM (SELECT record_seq AS seq, * FROM records)
WHERE table_name = (SELECT table_name FROM records ORDER BY record_seq LIMIT 1)""")
def get_table(spark, sf_dir):
    """All records of one table, by the raw name."""
    r = adapters.records(spark, sf_dir)
    name = r.orderBy("seq").select("table_name").first()
    return r.where(F.col("table_name") == (name[0] if name else "")).select("seq", "id_key", "timestamp")


_DOCUMENTS = "(SELECT doc_id AS seq, coalesce(lang, 'none') AS table_name, 's:' || coalesce(source, '') AS id_key FROM documents)"


@query(f"""SELECT seq, table_name FROM {_DOCUMENTS} WHERE id_key = (SELECT id_key FROM {_DOCUMENTS} GROUP BY id_key ORDER BY count(*) DESC, id_key LIMIT 1)""")
def get_string_id(spark, sf_dir):
    """All records of the string identifier that has most."""
    d = adapters.documents(spark, sf_dir)
    top = d.groupBy("id_key").count().orderBy(F.desc("count"), "id_key").first()
    return d.where(F.col("id_key") == (top["id_key"] if top else "")).select("seq", "table_name")


@query("""SELECT s AS typed, CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') AND try_cast(s AS INT) IS NOT NULL THEN 'i:' || try_cast(s AS INT) ELSE 's:' || s END AS id_key
FROM (VALUES ('007'), ('+5'), ('-5'), (' 5'), ('5.0'), ('3000000000'), (''), ('abc')) t(s)""")
def parse_ids(spark, sf_dir):
    s = spark.createDataFrame([(x,) for x in ("007", "+5", "-5", " 5", "5.0", "3000000000", "", "abc")], "typed string")
    kind, number, text = parse_id(F.col("typed"))
    return s.select("typed", F.when(kind == 1, F.concat(F.lit("i:"), number.cast("string"))).otherwise(F.concat(F.lit("s:"), text)).alias("id_key"))


@query("""SELECT r.record_seq FROM records r WHERE (segment, byte_offset) IN (SELECT (segment, byte_offset) FROM headers WHERE segment IS NOT NULL AND byte_offset IS NOT NULL
AND (hash IS NULL OR hash % 100 = 0))""")
def read_offsets(spark, sf_dir):
    """From index entries to their records: those of every hundredth hash, and those without a hash."""
    h = table(spark, sf_dir, "headers").where(F.col("hash").isNull() | (F.col("hash") % 100 == 0))
    return table(spark, sf_dir, "records").join(h.select("segment", "byte_offset").distinct(), ["segment", "byte_offset"], "left_semi").select("record_seq")


@query("""SELECT record_seq FROM records WHERE (segment, byte_offset) NOT IN (SELECT (segment, byte_offset) FROM headers WHERE segment IS NOT NULL AND byte_offset IS NOT NULL)""")
def missing_headers(spark, sf_dir):
    """Records that the index lacks, to be entered again."""
    h = table(spark, sf_dir, "headers").select("segment", "byte_offset").distinct()
    return table(spark, sf_dir, "records").join(h, ["segment", "byte_offset"], "left_anti").select("record_seq")


@query(f"""SELECT record_seq, 64 + coalesce(sum(size) OVER (PARTITION BY segment ORDER BY byte_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM
(SELECT record_seq, segment, byte_offset, 8 + (1 + strlen(table_name)) + CASE id_kind WHEN 1 THEN 5 WHEN 2 THEN 2 + strlen(id_str) ELSE 1 END
+ CASE WHEN octet_length(data) < 128 THEN 1 ELSE 2 END + octet_length(data) AS size FROM records)""")
def rebuilt_offsets(spark, sf_dir):
    """Offsets in segment files, rebuilt from the records with identifiers of all kinds."""
    r = adapters.records(spark, sf_dir)
    rows = r.select("table_name", "id_kind", "id_str", "data", "segment", F.col("seq").alias("record_seq"), F.col("byte_offset").alias("seq"))
    return seg.with_offsets(rows).select("record_seq", F.col("byte_offset").alias("at"))


# ---- through a store

_stores: dict[tuple[str, str], LogStore] = {}


def stored(spark: SparkSession, sf_dir: str) -> LogStore:
    """A store of all events, made once for the queries that only read it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        s = LogStore(spark, fresh_path(spark, "db"), max_records=N)
        s.add_records(adapters.events(spark, sf_dir), ["seq"])
        _stores[key] = s
    return _stores[key]


@query(f"SELECT {SHOWN_SQL} FROM {EVENTS} WHERE table_name = 'purchase' AND id_key = 'i:12'")
def store_get(spark, sf_dir):
    """``get_point`` through a store's sorted segments."""
    return stored(spark, sf_dir).get("purchase", 12).selectExpr(*SHOWN)


@query(f"SELECT {SHOWN_SQL} FROM {EVENTS} WHERE (table_name, id_key) IN (SELECT (table_name, id_key) FROM {EVENTS} WHERE seq % 100 = 0)")
def store_get_many(spark, sf_dir):
    e = adapters.events(spark, sf_dir)
    return stored(spark, sf_dir).get_many(e.where(F.col("seq") % 100 == 0).select("table_name", "id_key")).selectExpr(*SHOWN)


@query(f"""SELECT segment, records, records AS real_records, true AS ok FROM (SELECT segment, count(*) AS records FROM {EVENTS} GROUP BY segment)""")
def store_fsck(spark, sf_dir):
    return stored(spark, sf_dir).fsck()


@query(f"SELECT {SHOWN_SQL}, true AS whole FROM {EVENTS}")
def store_recovery(spark, sf_dir):
    """A store whose last writer broke off, its records written and its manifest not, takes in all events again."""
    s = LogStore(spark, fresh_path(spark, "db"), max_records=50_000)
    e = materialise(adapters.events(spark, sf_dir), "events")
    s.add_records(e.where(F.col("seq") % 3 != 0), ["seq"])
    left = s.records().limit(100).withColumn("seq", F.col("seq") + 10**9)
    left.write.partitionBy("segment").parquet(f"{s.path}/records/write=wbrokenoff")
    s.add_records(e, ["seq"])
    bad = s.fsck().where("NOT ok").count()
    return s.records().selectExpr(*SHOWN, f"{bad} = 0 AS whole")


_RECORD_BYTES = """8 + (1 + strlen(table_name)) + CASE id_kind WHEN 1 THEN 5 WHEN 2 THEN 2 + strlen(id_str) ELSE 1 END
+ CASE WHEN octet_length(data) < 128 THEN 1 ELSE 2 END + octet_length(data)"""


@query(f"""SELECT segment, 64 + coalesce(sum({_RECORD_BYTES}) OVER (PARTITION BY segment ORDER BY byte_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at,
ts AS timestamp, table_name, md5(data) AS data_md5 FROM records""")
def segment_scan(spark, sf_dir):
    """Segment files written with all records, then scanned in full, without an index."""
    r = adapters.records(spark, sf_dir).drop("seq").withColumnRenamed("byte_offset", "seq")
    at = adapters.segment_files(r, fresh_path(spark, "segment-files"))
    found = files.read_segments(spark, at)
    number = F.regexp_extract("path", r"([0-9]+)\.record$", 1).cast("int")
    return found.select(number.alias("segment"), F.col("pos").alias("at"), "timestamp", "table_name", F.md5("data").alias("data_md5"))


# ---- deduplication


@query(f"SELECT DISTINCT {SHOWN_SQL} FROM {REPLAY}")
def dedup_replay(spark, sf_dir):
    r = replayed(spark, sf_dir)
    return first_deliveries(r, IDENTITY, F.col("seq"), [], IDENTITY).selectExpr(*SHOWN)


@query(f"SELECT (SELECT count(*) FROM {REPLAY}) - (SELECT count(*) FROM (SELECT DISTINCT {SHOWN_SQL} FROM {REPLAY})) AS duplicates")
def duplicate_count(spark, sf_dir):
    r = replayed(spark, sf_dir).groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("n"))
    return r.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


_STORED = f"(SELECT * FROM {EVENTS} WHERE seq % 3 <> 0)"


@query(f"""SELECT count(*) AS seen, count(*) FILTER (WHERE seq % 3 = 0) AS added, count(*) FILTER (WHERE seq % 3 <> 0) AS duplicates FROM {EVENTS}""")
def ingest_added_duplicates(spark, sf_dir):
    """Two thirds of the events are stored; all come again."""
    e = adapters.events(spark, sf_dir)
    return added_and_duplicates(e, e.where(F.col("seq") % 3 != 0), IDENTITY)


@query(f"SELECT {SHOWN_SQL} FROM {EVENTS} WHERE seq % 3 = 0")
def ingest_new_rows(spark, sf_dir):
    e = adapters.events(spark, sf_dir)
    return e.dropDuplicates(IDENTITY).join(e.where(F.col("seq") % 3 != 0), IDENTITY, "left_anti").selectExpr(*SHOWN)


@query(f"""WITH z AS (SELECT segment, min(timestamp) AS lo, max(timestamp) AS hi FROM {EVENTS} GROUP BY segment)
SELECT seq, z.segment FROM {EVENTS} e JOIN z ON e.timestamp BETWEEN lo AND hi WHERE seq % 100 = 0""")
def zone_map_probe(spark, sf_dir):
    """Segments that may hold a duplicate of a record, by their times alone, for every hundredth record. Ranges meet
    by day, not by comparing all with all."""
    s = segmented(spark, sf_dir)
    day = 86_400_000
    zones = s.groupBy("segment").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    days = zones.withColumn("day", F.explode(F.sequence(F.floor(F.col("lo") / day), F.floor(F.col("hi") / day))))
    probes = s.where(F.col("seq") % 100 == 0).select("seq", "timestamp", F.floor(F.col("timestamp") / day).alias("day"))
    return probes.join(days, "day").where(F.col("timestamp").between(F.col("lo"), F.col("hi"))).select("seq", "segment")


# ---- segments


_STATS = f"""SELECT segment, count(*) AS records, count(DISTINCT (table_name, id_key, timestamp, data)) AS hashes,
min(timestamp) AS min_timestamp, max(timestamp) AS max_timestamp FROM {EVENTS} GROUP BY segment"""


@query(f"SELECT printf('%03d.record', segment) AS name, records, hashes, min_timestamp, max_timestamp FROM ({_STATS})")
def segment_info(spark, sf_dir):
    s = seg.stats(segmented(spark, sf_dir))
    return s.select(seg.segment_name(F.col("segment")).alias("name"), "records", "hashes", "min_timestamp", "max_timestamp")


@query(f"""SELECT name, name || ': r/o:' || (records >= 2000)::INT || ' v:2 records:' || records || ' headers:' || records || ' hashes:' || hashes
|| ' minTS:' || strftime(make_timestamp(min_timestamp * 1000), '%y-%m-%d_%H:%M:%S') || ' maxTS:' || strftime(make_timestamp(max_timestamp * 1000), '%y-%m-%d_%H:%M:%S') AS line
FROM (SELECT printf('%03d.record', segment) AS name, * FROM ({_STATS}))""")
def info_text(spark, sf_dir):
    s = LogStore(spark, fresh_path(spark, "db"), max_records=N)
    s.add_records(adapters.events(spark, sf_dir), ["seq"])
    return seg.info_lines(s.info())


def _size(table: str = "table_name", data: str = "data") -> str:
    u = "(CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 ELSE 4 END)"
    t, d = f"strlen({table})", f"strlen({data})"
    return f"(8 + {u.format(t)} + {t} + 5 + {u.format(d)} + {d})"


@query(f"""SELECT seq, segment, {_size()}::INT AS size, (64 + coalesce(sum({_size()}) OVER (PARTITION BY segment ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS byte_offset
FROM {EVENTS}""")
def record_offsets(spark, sf_dir):
    return seg.with_offsets(segmented(spark, sf_dir)).select("seq", "segment", "size", "byte_offset")


@query(f"SELECT segment, sum({_size()})::BIGINT AS total_bytes FROM {EVENTS} GROUP BY segment")
def bytes_total(spark, sf_dir):
    return seg.stats(segmented(spark, sf_dir)).select("segment", "total_bytes")


@query(f"SELECT max(segment) AS max_segment, count(DISTINCT segment) AS storages, max(segment) + 1 AS next_segment FROM {EVENTS}")
def max_segment(spark, sf_dir):
    return segmented(spark, sf_dir).agg(
        F.max("segment").alias("max_segment"), F.count_distinct("segment").alias("storages"), (F.coalesce(F.max("segment"), F.lit(0)) + 1).alias("next_segment")
    )


@query(f"SELECT segment FROM (SELECT segment, count(*) AS n FROM {EVENTS} GROUP BY segment) WHERE n < 2000")
def appendable_segments(spark, sf_dir):
    s = seg.stats(segmented(spark, sf_dir)).withColumns({"read_only": F.col("records") >= N, "archived": F.lit(False)})
    return appendable(s).select("segment")


@query("SELECT segment, count(*) AS records, min(ts) AS min_timestamp, max(ts) AS max_timestamp FROM records GROUP BY segment")
def records_info(spark, sf_dir):
    r = adapters.records(spark, sf_dir)
    return r.groupBy("segment").agg(F.count(F.lit(1)).alias("records"), F.min("timestamp").alias("min_timestamp"), F.max("timestamp").alias("max_timestamp"))


@query("""SELECT s.name, s.n_records = c.n AS count_ok, s.min_ts = c.lo AND s.max_ts = c.hi AS times_ok
FROM segments s LEFT JOIN (SELECT segment, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM records GROUP BY segment) c
ON c.segment = regexp_extract(s.name, '^([0-9]+)', 1)::INT""")
def fsck(spark, sf_dir):
    """The segments' heads against the records."""
    r = records_info(spark, sf_dir)
    s = table(spark, sf_dir, "segments").withColumn("segment", F.regexp_extract("name", "^([0-9]+)", 1).cast("int"))
    return s.join(r, "segment", "left").select(
        "name", (F.col("n_records") == F.col("records")).alias("count_ok"),
        ((F.col("min_ts") == F.col("min_timestamp")) & (F.col("max_ts") == F.col("max_timestamp"))).alias("times_ok"),
    )


@query(f"""WITH RECURSIVE rows AS (SELECT seq, row_number() OVER (ORDER BY seq) AS k, {_size()} AS size FROM {EVENTS}),
roll AS (SELECT seq, k, 64 + size AS used, 1 AS held, 1 AS segment FROM rows WHERE k = 1
UNION ALL SELECT r.seq, r.k, CASE WHEN g.used + r.size > 100000 OR g.held >= 900 THEN 64 ELSE g.used END + r.size,
CASE WHEN g.used + r.size > 100000 OR g.held >= 900 THEN 1 ELSE g.held + 1 END,
CASE WHEN g.used + r.size > 100000 OR g.held >= 900 THEN g.segment + 1 ELSE g.segment END FROM roll g JOIN rows r ON r.k = g.k + 1)
SELECT seq, segment FROM roll""")
def segment_rolling(spark, sf_dir):
    """Segments by size and number: 100,000 bytes or 900 records."""
    return seg.roll_segments(adapters.events(spark, sf_dir), ["seq"], 900, 100_000).select("seq", "segment")


@query(f"SELECT table_name, (row_number() OVER (ORDER BY min(seq)) - 1)::INT AS table_id FROM {EVENTS} GROUP BY table_name")
def table_dictionary(spark, sf_dir):
    return dictionary(adapters.events(spark, sf_dir))


def dictionary(log: DataFrame) -> DataFrame:
    """A dense number for each table, in order of first arrival. The window is over tables, not records."""
    first = log.groupBy("table_name").agg(F.min("seq").alias("first"))
    return first.select("table_name", (F.row_number().over(Window.orderBy("first")) - 1).alias("table_id"))


# ---- scalar functions


def _wrap(x: str) -> str:
    return f"((xor(({x}) & 4294967295, 2147483648)) - 2147483648)::INT"


_FOLD = _wrap("xor(timestamp >> 32, timestamp)")


@query(f"SELECT seq, {_FOLD} AS folded FROM {EVENTS}")
def timestamp_fold(spark, sf_dir):
    return adapters.events(spark, sf_dir).select("seq", ints.fold_timestamp(F.col("timestamp")).alias("folded"))


@query(f"SELECT seq, (id_int::BIGINT << 32) | ((seq * 7919) % 2001 - 1000) AS packed FROM {EVENTS}".replace("(id_int::BIGINT << 32)", "(id_int::BIGINT * 4294967296)"))
def pack_key(spark, sf_dir):
    """Packed keys with low halves of both signs."""
    e = adapters.events(spark, sf_dir)
    low = (F.col("seq") * 7919 % 2001 - 1000).cast("int")
    return e.select("seq", ints.pack_key(F.col("id_int"), low).alias("packed"))


@query(f"SELECT seq, id_int AS high, (seq % 1000000)::INT AS low FROM {EVENTS}")
def unpack_offset(spark, sf_dir):
    e = adapters.events(spark, sf_dir)
    high, low = ints.unpack_offset(ints.pack_offset(F.col("id_int"), F.col("seq") % 1000000))
    return e.select("seq", high.alias("high"), low.alias("low"))


_REVERSED = "list_reduce(list_transform(range(0, 32), lambda i: ((table_id >> i) & 1) << (31 - i)), lambda a, b: a | b)"


@query(f"""SELECT seq, {_wrap(f"xor({_wrap(_REVERSED)}, id_int)")} AS table_plus_id FROM {EVENTS}
JOIN (SELECT table_name, (row_number() OVER (ORDER BY min(seq)) - 1)::BIGINT AS table_id FROM {EVENTS} GROUP BY table_name) USING (table_name)""")
def table_plus_id(spark, sf_dir):
    e = adapters.events(spark, sf_dir)
    return e.join(dictionary(e), "table_name").select("seq", ints.table_plus_id(F.col("table_id"), F.col("id_int")).alias("table_plus_id"))


@query("SELECT doc_id, CASE WHEN strlen(text) < 128 THEN 1 WHEN strlen(text) < 16384 THEN 2 WHEN strlen(text) < 2097152 THEN 3 ELSE 4 END AS size FROM documents WHERE text IS NOT NULL")
def uint29_size(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", ints.uint29_size(F.octet_length("text")).alias("size"))


@query(f"SELECT seq, (timestamp + 10800000) // 86400000 AS day, (timestamp + 10800000) / 86400000.0::DOUBLE AS day_double FROM {EVENTS}")
def msk_day(spark, sf_dir):
    ts = F.col("timestamp")
    return adapters.events(spark, sf_dir).select("seq", dates.msk_day(ts).alias("day"), dates.msk_day_double(ts).alias("day_double"))


@query(f"SELECT seq, strftime(make_timestamp(timestamp * 1000), '%a, %d %b %Y %H:%M:%S GMT') AS text FROM {EVENTS}")
def http_date(spark, sf_dir):
    return adapters.events(spark, sf_dir).select("seq", dates.http_date(F.col("timestamp")).alias("text"))


#: Months as whole days of 1/32 month apart, after the end's day is moved where its time of day falls short.
_MONTHS = """trunc(((year(e) * 12 + month(e)) * 32 + day(e) - (year(a) * 12 + month(a)) * 32 - day(a)) / 32)::INT"""


@query(f"""SELECT o_orderkey, datesub('day', a, b)::INT AS days, {_MONTHS} AS months, trunc({_MONTHS} / 12)::INT AS years FROM
(SELECT *, b::DATE + CASE WHEN b >= a AND b::TIME < a::TIME THEN -1 WHEN b < a AND b::TIME > a::TIME THEN 1 ELSE 0 END AS e FROM
(SELECT o_orderkey, o_orderdate AS a, TIMESTAMP '2024-02-29 12:00:00' AS b FROM orders))""")
def dates_between(spark, sf_dir):
    a, b = F.col("o_orderdate").cast("timestamp"), F.to_timestamp(F.lit("2024-02-29 12:00:00"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.days_between(a, b).alias("days"), dates.months_between(a, b).alias("months"), dates.years_between(a, b).alias("years")
    )


@query(f"""SELECT seq, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d %H:%M:%S') AS shown, make_timestamp(timestamp * 1000)::DATE::VARCHAR AS day,
epoch_us(date_trunc('day', make_timestamp(timestamp * 1000))) // 1000 AS midnight, timestamp // 1000 * 1000 AS again FROM {EVENTS}""")
def date_conversions(spark, sf_dir):
    ts = F.col("timestamp")
    shown = dates.format_datetime(ts)
    return adapters.events(spark, sf_dir).select(
        "seq", shown.alias("shown"), dates.to_local_date(ts).cast("string").alias("day"),
        dates.date_to_millis(dates.to_local_date(ts)).alias("midnight"), dates.to_millis(dates.parse_datetime(shown)).alias("again"),
    )


@query(f"""SELECT seq, CASE WHEN seq % 2 = 0 THEN table_name ELSE 'ros_' || table_name END AS name,
(CASE WHEN seq % 2 = 0 THEN table_name ELSE 'ros_' || table_name END) || '/' || id_int AS record_key FROM {EVENTS}""")
def normalize_key(spark, sf_dir):
    """``ros.`` is stripped, ``ros_`` isn't."""
    name = F.concat(F.when(F.col("seq") % 2 == 0, "ros.").otherwise("ros_"), F.col("table_name"))
    return adapters.events(spark, sf_dir).select(
        "seq", strings.normalized_table(name).alias("name"), strings.record_key(name, F.col("id_int").cast("string")).alias("record_key")
    )


@query(f"""SELECT seq, table_name AS trimmed, printf('%06d', seq) AS padded, CASE WHEN suffix(table_name, 'e') THEN left(table_name, length(table_name) - 1) END AS chopped FROM {EVENTS}""")
def string_functions(spark, sf_dir):
    messy = F.concat(F.lit("\t\x01 \n"), F.col("table_name"), F.lit(" \x1f\r\n"))
    return adapters.events(spark, sf_dir).select(
        "seq", strings.trim_controls(messy).alias("trimmed"), strings.zero_pad(F.col("seq"), 6).alias("padded"),
        strings.maybe_chop_ending(F.col("table_name"), "e").alias("chopped"),
    )


from .problems_sql import TEXT  # noqa: E402


@query(f"SELECT record_seq, md5({TEXT}) AS text_md5, length({TEXT})::INT AS n_chars FROM records")
def decoded_text(spark, sf_dir):
    """Text of records in two encodings."""
    t = log_text(F.col("data"))
    return table(spark, sf_dir, "records").select("record_seq", F.md5(t.cast("binary")).alias("text_md5"), F.length(t).alias("n_chars"))


_BYTE = "('0x' || substr(hex({0}), 2 * ({1}) + 1, 2))::UBIGINT"


def _murmur_sql(data: str) -> str:
    """MurmurHash3 x86 32 with seed 0 in SQL, unsigned."""

    def rot(x: str, r: int) -> str:
        return f"(((({x}) << {r}) | (({x}) >> {32 - r})) & 4294967295)"

    def mul(x: str, c: int) -> str:
        return f"((({x}) * {c}::UBIGINT) & 4294967295)"

    def byte(i: str) -> str:
        return _BYTE.format(data, i)

    n = f"octet_length({data})"
    block = f"({byte('4 * i')} | ({byte('4 * i + 1')} << 8) | ({byte('4 * i + 2')} << 16) | ({byte('4 * i + 3')} << 24))"
    mixed = f"list_transform(range(0, {n} // 4), lambda i: {mul(rot(mul(block, 0xCC9E2D51), 15), 0x1B873593)})"
    step = f"({mul(rot('xor(h, k)', 13), 5)} + 3864292196::UBIGINT) & 4294967295"
    h = f"list_reduce(list_prepend(0::UBIGINT, {mixed}), lambda h, k: {step})"
    at = f"({n} // 4 * 4)"
    tail = f"(CASE WHEN {n} % 4 > 0 THEN {byte(at)} ELSE 0::UBIGINT END | CASE WHEN {n} % 4 > 1 THEN {byte(at + ' + 1')} << 8 ELSE 0::UBIGINT END | CASE WHEN {n} % 4 > 2 THEN {byte(at + ' + 2')} << 16 ELSE 0::UBIGINT END)"
    h = f"xor(xor({h}, {mul(rot(mul(tail, 0xCC9E2D51), 15), 0x1B873593)}), {n}::UBIGINT)"
    # the last steps as a fold over (shift, factor) pairs
    return f"list_reduce([{h}, 1::UBIGINT, 2::UBIGINT, 3::UBIGINT], lambda a, s: CASE s WHEN 1 THEN {mul('xor(a, a >> 16)', 0x85EBCA6B)} WHEN 2 THEN {mul('xor(a, a >> 13)', 0xC2B2AE35)} ELSE xor(a, a >> 16) END)"


_MURMUR = f"(xor({_murmur_sql('data')}, 2147483648::UBIGINT)::BIGINT - 2147483648)::INT"
_CALC = f"xor({_MURMUR}, {_wrap('xor(ts >> 32, ts)')})"


@query(f"SELECT record_seq, {_MURMUR} AS hash FROM records")
def murmur3(spark, sf_dir):
    return table(spark, sf_dir, "records").select("record_seq", hashing.murmur3(F.col("data")).alias("hash"))


@query(f"SELECT record_seq, {_CALC} AS hash FROM records")
def calc_hash(spark, sf_dir):
    return table(spark, sf_dir, "records").select("record_seq", hashing.calc_hash(F.col("data"), F.col("ts")).alias("hash"))


@query(f"""SELECT h.segment, h.byte_offset, h.hash = r.hash AS hash_ok, h.ts = r.ts AND h.table_name = r.table_name AS rest_ok
FROM headers h JOIN (SELECT segment, byte_offset, ts, table_name, {_CALC} AS hash FROM records) r ON h.segment = r.segment AND h.byte_offset = r.byte_offset""")
def headers_checked(spark, sf_dir):
    """Index entries against the records they point to."""
    r = table(spark, sf_dir, "records").select("segment", "byte_offset", F.col("ts").alias("r_ts"), F.col("table_name").alias("r_table"), hashing.calc_hash(F.col("data"), F.col("ts")).alias("r_hash"))
    h = table(spark, sf_dir, "headers")
    return h.join(r, ["segment", "byte_offset"]).select(
        "segment", "byte_offset", (F.col("hash") == F.col("r_hash")).alias("hash_ok"), ((F.col("ts") == F.col("r_ts")) & (F.col("table_name") == F.col("r_table"))).alias("rest_ok")
    )


_STRING_HASH = """list_reduce(list_prepend(0::BIGINT, list_transform(range(0, strlen(id_str)), lambda i:
(CASE WHEN ('0x' || substr(hex(encode(id_str)), 2 * i + 1, 2))::BIGINT > 127 THEN ('0x' || substr(hex(encode(id_str)), 2 * i + 1, 2))::BIGINT - 256 ELSE ('0x' || substr(hex(encode(id_str)), 2 * i + 1, 2))::BIGINT END))),
lambda h, b: xor((h * 31 + b) & 4294967295, 2147483648) - 2147483648)"""


@query(f"SELECT record_seq, (CASE id_kind WHEN 1 THEN id_int WHEN 2 THEN {_STRING_HASH} ELSE 0 END)::INT AS id_hash FROM records")
def record_id_hash(spark, sf_dir):
    return table(spark, sf_dir, "records").select("record_seq", hashing.record_id_hash(F.col("id_kind"), F.col("id_int"), F.col("id_str")).alias("id_hash"))


def compat_kept(log: DataFrame) -> DataFrame:
    """``seq`` of what is kept under the lossy key: table number and identifier in the high half, the hash in the low
    one, which wipes out the high half if it is negative. A table's first record is always kept. One segment."""
    low = hashing.calc_hash(F.col("data"), F.col("timestamp"))
    ident = hashing.record_id_hash(F.col("id_kind"), F.col("id_int"), F.col("id_str"))
    keyed = log.withColumns({"__low": low, "__id": ident}).join(dictionary(log), "table_name")
    keyed = keyed.select("seq", "table_name", ints.pack_key(ints.table_plus_id(F.col("table_id"), F.col("__id")), F.col("__low")).alias("packed"))
    return keyed.groupBy("packed").agg(F.min("seq").alias("seq")).select("seq").union(keyed.groupBy("table_name").agg(F.min("seq").alias("seq")).select("seq")).distinct()


_COMPAT = f"""WITH r AS (SELECT record_seq AS seq, table_name, {_CALC}::BIGINT AS low, (CASE id_kind WHEN 1 THEN id_int WHEN 2 THEN {_STRING_HASH} ELSE 0 END)::BIGINT AS ident FROM records),
d AS (SELECT table_name, (row_number() OVER (ORDER BY min(seq)) - 1)::BIGINT AS table_id, min(seq) AS first FROM r GROUP BY table_name),
k AS (SELECT seq, ({_wrap(f"xor({_wrap(_REVERSED)}, ident)")}::BIGINT * 4294967296) | low AS packed FROM r JOIN d USING (table_name))
SELECT min(seq) AS seq FROM k GROUP BY packed UNION SELECT first AS seq FROM d"""


@query(_COMPAT)
def compat_dedup(spark, sf_dir):
    return compat_kept(adapters.records(spark, sf_dir))


# ---- text logs

_PARTS = "string_split(text, chr(10) || chr(10))"


@query(f"""SELECT doc_id, i AS n, md5(CASE WHEN i = 0 THEN {_PARTS}[1] ELSE chr(10) || chr(10) || {_PARTS}[i + 1] END) AS piece_md5
FROM (SELECT doc_id, text, unnest(range(0, len({_PARTS})))::INT AS i FROM documents WHERE text IS NOT NULL)""")
def legacy_split(spark, sf_dir):
    """Texts split before each blank line."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.posexplode(strings.split_before(F.col("text"), "\n\n")).alias("n", "piece")).select("doc_id", "n", F.md5(F.col("piece").cast("binary")).alias("piece_md5"))


def blocks(log: DataFrame) -> DataFrame:
    """Events as blocks of a legacy log; every seventh has no identifier."""
    head = F.concat(F.lit("---- "), dates.format_datetime(F.col("timestamp")), F.when(F.col("seq") % 7 != 0, F.concat(F.lit(" id:"), F.col("id_int").cast("string"))).otherwise(""))
    return log.select("seq", "table_name", F.concat(head, F.lit("\n"), F.col("data").cast("string")).alias("block"))


@query(f"SELECT seq, CASE WHEN seq % 7 <> 0 THEN id_int END AS id_int, timestamp // 1000 * 1000 AS ts FROM {EVENTS}")
def legacy_fields(spark, sf_dir):
    id_int, ts = strings.legacy_fields(F.col("block"))
    return blocks(adapters.events(spark, sf_dir)).select("seq", id_int.alias("id_int"), ts.alias("ts"))


_LEGACY = f"""SELECT DISTINCT table_name, CASE WHEN seq % 7 <> 0 THEN 'i:' || id_int ELSE '' END AS id_key, timestamp // 1000 * 1000 AS timestamp,
md5('---- ' || strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d %H:%M:%S') || CASE WHEN seq % 7 <> 0 THEN ' id:' || id_int ELSE '' END || chr(10) || data) AS data_md5 FROM {EVENTS}"""


@query(_LEGACY)
def legacy_import(spark, sf_dir):
    """Events written as legacy logs, plain text by table, read back and added to a store."""
    at = fresh_path(spark, "legacy")
    blocks(adapters.events(spark, sf_dir)).select("block", "table_name").write.partitionBy("table_name").option("lineSep", "\n\n").text(f"{at}/parts")
    fs, p = _fs(spark, f"{at}/parts")
    month = _fs(spark, f"{at}/month")[1]
    fs.mkdirs(month)
    n = 0
    for d in fs.listStatus(p):
        if d.isDirectory():
            for f in fs.listStatus(d.getPath()):
                name = d.getPath().getName().partition("=")[2]
                fs.rename(f.getPath(), _fs(spark, f"{at}/month/{name}.sql.{n:05d}")[1])
                n += 1
    s = LogStore(spark, f"{at}/db")
    convert(s, files.read_legacy(spark, f"{at}/month"))
    return s.records().select("table_name", "id_key", "timestamp", F.md5("data").alias("data_md5"))


# ---- spool files, store, streaming


def _spooled(spark: SparkSession, log: DataFrame) -> str:
    spark.dataSource.register(client.SavedDataSource)
    at = fresh_path(spark, "spool")
    log.select("table_name", "id_kind", "id_int", "id_str", "timestamp", "data").write.format("saved").mode("append").option("path", at).save()
    return at


@query(f"SELECT {SHOWN_SQL} FROM {REPLAY}")
def saved_roundtrip(spark, sf_dir):
    """Spool files written and read."""
    return files.read_saved(spark, _spooled(spark, replayed(spark, sf_dir))).selectExpr(*SHOWN)


@query(f"""SELECT table_name, {ID_KEY} AS id_key, ts AS timestamp, count(*) AS n FROM records WHERE octet_length(data) > 0 AND table_name <> '' GROUP BY ALL""")
def saved_source(spark, sf_dir):
    """Records with identifiers of all kinds through the data source."""
    r = adapters.records(spark, sf_dir).where((F.octet_length("data") > 0) & (F.col("table_name") != ""))
    from ..schema import with_id_key

    back = spark.read.format("saved").option("path", _spooled(spark, r)).load()
    return with_id_key(back).groupBy("table_name", "id_key", "timestamp").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT {SHOWN_SQL} FROM {REPLAY}")
def stream_update(spark, sf_dir):
    """Spool files ingested by a stream in small batches into a store."""
    s = LogStore(spark, fresh_path(spark, "db"))
    update(s, _spooled(spark, replayed(spark, sf_dir).repartition(6)), batch_bytes=4 << 20)
    return s.records().selectExpr(*SHOWN)


@query(f"SELECT DISTINCT {SHOWN_SQL} FROM {EVENTS}")
def archive(spark, sf_dir):
    """A store is archived, then added to again: nothing of it is new."""
    s = LogStore(spark, fresh_path(spark, "db"), max_records=100_000)
    e = adapters.events(spark, sf_dir)
    s.add_records(e.where(F.col("seq") % 2 == 0), ["seq"])
    s.archive()
    s.add_records(e, ["seq"])
    return s.records().selectExpr(*SHOWN)


@query(f"""SELECT seq, '{{"timestamp":' || timestamp || ',"tableName":"' || table_name || '","id":' || id_int || ',"data":' || to_json(data) || '}}' AS json FROM {EVENTS}""")
def json_rows(spark, sf_dir):
    return as_json(adapters.events(spark, sf_dir)).select("seq", "json")


@query("""SELECT count(*) FILTER (WHERE table_name IS NOT NULL AND table_name <> '' AND table_name <> chr(0) AND octet_length(log_bytes) BETWEEN 1 AND 1048576) AS good,
count(*) FILTER (WHERE NOT coalesce(table_name IS NOT NULL AND table_name <> '' AND table_name <> chr(0) AND octet_length(log_bytes) BETWEEN 1 AND 1048576, false)) AS bad FROM source_records""")
def quarantine(spark, sf_dir):
    r = table(spark, sf_dir, "source_records").select("table_name", F.col("log_bytes").alias("data"), F.lit(None).cast("string").alias("error"))
    good, bad = files.quarantine(r)
    both = good.select(F.lit(1).alias("g")).unionByName(bad.select(F.lit(0).alias("g")))
    return both.agg(F.coalesce(F.sum("g"), F.lit(0)).alias("good"), F.count_if(F.col("g") == 0).alias("bad"))


# ---- adaptive arrays


@query("""SELECT record_seq, CASE WHEN id_int = 0 THEN 'EMPTY_LONG' WHEN id_int IS NOT NULL THEN 'INT_LONG' END AS of_int,
CASE WHEN id_str IS NULL THEN NULL WHEN id_str = '' THEN 'EMPTY_STRING'
WHEN coalesce(CASE WHEN regexp_full_match(id_str, '-?[0-9]+') THEN try_cast(id_str AS BIGINT) END::VARCHAR = id_str, false) THEN
CASE WHEN id_str::BIGINT > -2147483648 AND id_str::BIGINT <= 2147483647 THEN 'INT_STRING' WHEN id_str::BIGINT > -9223372036854775808 THEN 'LONG_STRING' ELSE 'STRING' END ELSE 'STRING' END AS of_str,
CASE WHEN ts = 0 THEN 'EMPTY_LONG' WHEN ts BETWEEN -2147483648 AND 2147483647 THEN 'INT_LONG' ELSE 'LONG' END AS of_ts FROM records""")
def encoding_of_value(spark, sf_dir):
    r = table(spark, sf_dir, "records")
    return r.select(
        "record_seq", arrays.encoding_of_long(F.col("id_int")).alias("of_int"), arrays.encoding_of_string(F.col("id_str")).alias("of_str"),
        arrays.encoding_of_long(F.col("ts")).alias("of_ts"),
    )


@query(f"""SELECT id_int, array_agg(timestamp ORDER BY seq)::VARCHAR AS vals, count(*) AS size, 'LONG' AS encoding FROM {EVENTS} GROUP BY id_int""")
def collect_array(spark, sf_dir):
    e = adapters.events(spark, sf_dir)
    got = arrays.collected(e, "id_int", "seq", "timestamp", arrays.encoding_of_long(F.col("timestamp")))
    return got.select("id_int", F.concat(F.lit("["), F.array_join(F.col("values").cast("array<string>"), ", "), F.lit("]")).alias("vals"), "size", "encoding")
