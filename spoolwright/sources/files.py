"""Log files as DataFrames: spool files, legacy text logs and segment files.

Files come in through Spark's ``binaryFile`` source, so that listing, splitting over tasks, streaming and the file
system are the engine's, and are decoded in Arrow batches. Every row has ``path`` and ``pos``, its place in the order
of arrival: paths in order, then position.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import codec
from ..functions import strings
from ..functions.text import log_text
from ..schema import with_id_key

SAVED_GLOB = "*.saved{,.gz}"
RECORD_GLOB = "*.record{,.gz}"
_ROWS = "path string, pos bigint, table_name string, id_kind tinyint, id_int int, id_str string, timestamp bigint, data binary, error string"
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int8(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.string()]
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
#: Decoded rows that leave at once.
BATCH = 10_000


def binary_files(spark: SparkSession, paths: str | Sequence[str], glob: str, recursive: bool = True) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    r = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    return (r.option("recursiveFileLookup", "true") if recursive else r).load(paths)


def _decode(files: DataFrame, rows_of: Callable[[str, bytes], Iterator[tuple]], content: str = "content") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

        rows: list[tuple] = []
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for row in rows_of(path, content):
                    rows.append(row)
                    if len(rows) >= BATCH:
                        yield out(rows)
                        rows = []
        if rows:
            yield out(rows)

    return files.select("path", content).mapInArrow(run, _ROWS)


def decode_saved(files: DataFrame, strict: bool = True) -> DataFrame:
    """Records of spool files given as ``path, content``. With ``strict`` a bad file fails the job, with its path and
    position; else the records before the fault come out, then a row with ``error`` and nothing else."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        pos = 0
        try:
            for pos, (table, kind, number, text, ts, data) in enumerate(codec.read_saved(content, path)):
                yield path, pos, table, kind, number, text, ts, data, None
        except (codec.FormatError, OSError, EOFError) as e:
            if strict:
                raise
            yield path, pos + 1, None, None, None, None, None, None, str(e)

    return _decode(files, rows)


def read_saved(spark: SparkSession, paths: str | Sequence[str], strict: bool = True) -> DataFrame:
    """All ``*.saved`` and ``*.saved.gz`` files below the paths."""
    return with_id_key(decode_saved(binary_files(spark, paths, SAVED_GLOB), strict))


def quarantine(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and what is to be looked at: faults of files, and rows that would be refused: an empty table name or
    log, or a field over 1 MiB."""
    limit = codec.MAX_FIELD
    ok = (
        F.col("error").isNull()
        & (F.coalesce(F.col("table_name"), F.lit("")) != "")
        & (F.col("table_name") != "\0")
        & (F.coalesce(F.octet_length("data"), F.lit(0)).between(1, limit))
        & (F.octet_length("table_name") <= limit)
    )
    ok = F.coalesce(ok, F.lit(False))
    return decoded.where(ok), decoded.where(~ok)


def read_legacy(spark: SparkSession, folders: str | Sequence[str]) -> DataFrame:
    """Legacy text logs, ``<table>.sql.*[.gz]`` directly in the folders: blocks that begin with ``---- ``, in UTF-8 or
    windows-1251. Blocks without a line end, empty files and files of other names are passed over. One folder is a
    month, its parent's folders in order of name are a year."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        if content:
            for pos, piece in enumerate(codec.split_stream(io.BytesIO(codec.unzip(content, path)), strings.BLOCK.encode())):
                yield path, pos, None, None, None, None, None, piece, None

    files = binary_files(spark, folders, "*.sql.*", recursive=False).where("length > 0")
    blocks = _decode(files, rows).select(
        "path", "pos", strings.legacy_table(F.element_at(F.split("path", "/"), -1)).alias("table_name"),
        strings.trim_controls(log_text(F.col("data"), replacement_means_cp1251=True)).alias("block"),
    )
    blocks = blocks.where(F.col("table_name").isNotNull() & F.contains("block", F.lit("\n")))
    id_int, ts = strings.legacy_fields(F.col("block"))
    return with_id_key(
        blocks.select(
            "path", "pos", "table_name",
            F.when(id_int.isNull(), 0).otherwise(1).cast("tinyint").alias("id_kind"), id_int.alias("id_int"), F.lit(None).cast("string").alias("id_str"),
            ts.alias("timestamp"), F.col("block").cast("binary").alias("data"),
        )
    )


def year_folders(spark: SparkSession, path: str) -> list[str]:
    """The months of a year, in order of name."""
    from ..operators.compaction import sub_folders

    return [f"{path}/{f}" for f in sub_folders(spark, path)]


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """All records of segment files (``NNN.record[.gz]``), with ``pos`` their byte offset: a full scan that needs no
    index and drops a last record that is cut off. The engine lists the files; a task opens them and reads on as it
    goes, so that files may have any size."""

    def rows(path: str, _: int) -> Iterator[tuple]:
        import pyarrow.fs as pfs

        fs, at = pfs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
        with fs.open_input_file(at) as f:
            for at, (table, kind, number, text, ts, data) in codec.read_segment(io.BufferedReader(f, 1 << 20), path):
                yield path, at, table, kind, number, text, ts, data, None

    return with_id_key(_decode(binary_files(spark, path, RECORD_GLOB, recursive=False), rows, "length").drop("error"))
