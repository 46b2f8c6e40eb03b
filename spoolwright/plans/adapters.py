"""Driver tables as log records."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import codec
from ..functions.dates import to_millis
from ..operators import segments as seg
from ..operators.compaction import SPOOL_SCHEMA
from ..schema import id_key
from ..session import broadcast_if_small, table


def _log(df: DataFrame, name, id_int, id_str, ts, data, seq) -> DataFrame:
    kind = 0 if id_int is None and id_str is None else 1 if id_str is None else 2
    out = df.select(
        name.alias("table_name"), F.lit(kind).cast("tinyint").alias("id_kind"),
        (F.lit(None) if id_int is None else id_int).cast("int").alias("id_int"), (F.lit(None) if id_str is None else id_str).cast("string").alias("id_str"),
        ts.cast("bigint").alias("timestamp"), data.cast("binary").alias("data"), seq.cast("bigint").alias("seq"),
    )
    return out.withColumn("id_key", id_key())


def events(spark: SparkSession, sf_dir: str, name: str | None = None, ident: int | None = None) -> DataFrame:
    """event_type as table, user_id as identifier, props as data; with ``name`` and ``ident`` those of one key, which the
    scan is told in the columns' own types."""
    e = table(spark, sf_dir, "events")
    if name is not None:
        e = e.where((F.col("event_type") == name) & (F.col("user_id") == ident))
    return _log(e, F.col("event_type"), F.col("user_id"), None, to_millis(F.col("ts")), F.col("props"), F.col("event_id"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang as table, the repository as string identifier, text as data."""
    d = table(spark, sf_dir, "documents")
    return _log(d, F.coalesce("lang", F.lit("none")), None, F.col("source"), F.col("doc_id"), F.col("text"), F.col("doc_id"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of all kinds, data in two encodings."""
    r = table(spark, sf_dir, "records")
    return r.select("table_name", "id_kind", "id_int", "id_str", F.col("ts").alias("timestamp"), "data", F.col("record_seq").alias("seq"), "segment", "byte_offset", id_key().alias("id_key"))


def scattered(source_records: DataFrame, at: str) -> str:
    """Lays source records out as what they come from: a file of JSON lines for each ``file_no``, named by it, a thousand
    to a folder below ``at``. Gives ``at``. A task that runs again writes the same files again."""
    columns = [c.split()[0] for c in SPOOL_SCHEMA.split(", ")]
    rows = source_records.select("file_no", "pos", F.to_json(F.struct(*columns)).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pfs

        fs, root = pfs.FileSystem.from_uri(at)
        number, lines, made = None, [], set()

        def flush() -> None:
            if lines:
                folder = f"{root}/{'none' if number is None else number // 1000}"
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/_{number}-{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write("".join(x + "\n" for x in lines).encode())
                fs.move(part, f"{folder}/{number}.json")
                lines.clear()

        for b in batches:
            for n, line in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if n != number:
                    flush()
                    number = n
                lines.append(line)
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["n"])

    rows.repartition("file_no").sortWithinPartitions("file_no", "pos").mapInArrow(run, "n bigint").count()
    return at


def segment_files(log: DataFrame, at: str) -> str:
    """Writes records (with ``segment`` and ``seq``, their order) as segment files ``NNN.record`` below ``at``, a task going
    through a segment's records as they come. Gives ``at``."""
    heads = seg.stats(log)
    rows = log.select("segment", "seq", "table_name", "id_kind", "id_int", "id_str", "timestamp", "data").join(
        broadcast_if_small(heads.select("segment", "records", "min_timestamp", "max_timestamp", "total_bytes")), "segment"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pfs

        fs, root = pfs.FileSystem.from_uri(at)
        fs.create_dir(root, recursive=True)
        number, out, part = None, None, ""

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(part, f"{root}/{number:03d}.record")

        for b in batches:
            for n, _, table, kind, i, text, ts, data, k, lo, hi, size in zip(*(c.to_pylist() for c in b.columns)):
                if n != number:
                    close()
                    number, part = n, f"{root}/_{uuid.uuid4().hex}"
                    out = fs.open_output_stream(part)
                    out.write(codec.segment_head_bytes(size + codec.RECORD_HEAD, lo, max(0, hi), k))
                out.write(codec.segment_record(table, kind, i, text, ts, data))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["n"])

    rows.repartition("segment").sortWithinPartitions("segment", "seq").mapInArrow(run, "n bigint").count()
    return at
