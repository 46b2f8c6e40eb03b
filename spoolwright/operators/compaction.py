"""Far too many small files: consolidation without a shuffle.

Consolidation rests on the engine's own split packing: with ``spark.sql.files.maxPartitionBytes`` at the target size and
``spark.sql.files.openCostInBytes`` at what opening a file costs, one task reads as many small files as fit. The packed
splits, coalesced to the number of files wanted, are written straight out, so no row is shuffled. The output is written
to a staging folder; what passed by on the way there is counted and hashed, read again and compared, and only then
moved into place, all folders at once. A run that fails leaves the input as it was and nothing new at the destination.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import broadcast_if_small, conf
from ..storage import fs_of as _fs

TARGET_BYTES = 128 << 20
#: What opening a file costs, as bytes read in that time.
OPEN_COST = 128 << 10
#: Folders that one job packs.
AT_ONCE = 200


class VerificationError(RuntimeError):
    """What was written is not what was read."""


def file_sizes(spark: SparkSession, path: str) -> list[int]:
    """Sizes of the data files directly in a folder."""
    fs, p = _fs(spark, path)
    return [s.getLen() for s in fs.listStatus(p) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]


def sub_folders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith(("_", ".")))


def _sums(df: DataFrame) -> list[Column]:
    cols: list[Column] = []
    for c, t in df.dtypes:
        v = F.col(f"`{c}`")
        # hashes pass over nulls, so whether there is one goes in beside the value
        cols += [v.isNull(), F.to_json(v) if t.startswith("map") else v]
    h = F.xxhash64(*cols)
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("sum"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor")]


def fingerprint(df: DataFrame) -> tuple[int, int, int]:
    """Count, sum and xor of the rows' 64-bit hashes: two tables that hold the same rows, as often, agree whatever
    their order. Maps are hashed through their JSON form."""
    return tuple(df.agg(*_sums(df)).first())


def _write_checked(rows: DataFrame, written: Callable[[], DataFrame], write: Callable[[DataFrame], None], what: str) -> None:
    """Writes ``rows``, taking their fingerprint as they pass, and compares it with that of what is read again."""
    seen = Observation()
    write(rows.observe(seen, *_sums(rows)))
    got = seen.get
    before, after = (got["n"], got["sum"], got["xor"]), fingerprint(written())
    if before != after:
        raise VerificationError(f"{what}: read {before}, wrote {after}")


def gather_files(rows: DataFrame, out: str) -> DataFrame:
    """Writes ``rows``, a scan of small files with filters and projections alone, as one file for each of its packed splits,
    checked; gives what was written. Run it, and make the scan, within ``packed_splits``."""
    spark = rows.sparkSession
    _write_checked(rows, lambda: spark.read.schema(rows.schema).parquet(out), lambda d: d.write.mode("overwrite").parquet(out), out)
    return spark.read.schema(rows.schema).parquet(out)


def packed_splits(spark: SparkSession, target_bytes: int, open_cost: int):
    """The settings under which the engine packs files into splits of about ``target_bytes``, a file weighing its size and
    ``open_cost``. Splits aren't made smaller so that every core gets one: few files are the aim here."""
    return conf(
        spark,
        spark__sql__files__maxPartitionBytes=target_bytes,
        spark__sql__files__openCostInBytes=min(open_cost, max(1, target_bytes // 64)),
        spark__sql__files__minPartitionNum=1,
        spark__sql__maxConcurrentOutputFileWriters=4,  # a task that writes to one folder needs no sort by folder
        spark__sql__unionOutputPartitioning=False,  # a union of scans of one split each would by itself become one task
    )


def _pack(spark: SparkSession, src: str, staged: str, folders: list[str], sizes: dict[str, list[int]], target_bytes: int, fmt: str, schema: StructType) -> None:
    """Packs some folders in one job: a union of scans, each of one folder's packed splits, coalesced to its number of
    files. A task of the union thus belongs to one folder and writes one file."""

    def scan(i: int, f: str) -> DataFrame:
        want = max(1, math.ceil(sum(sizes[f]) / target_bytes))
        return spark.read.format(fmt).schema(schema).load(f"{src}/{f}").coalesce(want).withColumn("__folder", F.lit(i))

    rows = reduce(DataFrame.unionByName, [scan(i, f) for i, f in enumerate(folders)])
    whole = StructType([*schema.fields, StructField("__folder", IntegerType())])
    _write_checked(
        rows,
        lambda: spark.read.format(fmt).schema(whole).load(staged),
        lambda d: d.write.format(fmt).mode("overwrite").partitionBy("__folder").save(staged),
        src,
    )


def _swap(spark: SparkSession, new: str, dst: str) -> None:
    """Puts the folder ``new`` in the place of ``dst``; what was there is gone only afterwards."""
    fs, p = _fs(spark, dst)
    old = _fs(spark, dst + "_replaced")[1]
    if fs.exists(p):
        fs.delete(old, True)
        if not fs.rename(p, old):
            raise VerificationError(f"could not move {p}")
    fs.mkdirs(p.getParent())
    if not fs.rename(_fs(spark, new)[1], p):
        fs.rename(old, p)
        raise VerificationError(f"could not move {new} to {p}")
    fs.delete(old, True)


def pack_small_files(
    spark: SparkSession, src: str, dst: str, target_bytes: int = TARGET_BYTES, open_cost: int = OPEN_COST, fmt: str = "parquet", schema: StructType | None = None
) -> dict[str, tuple[int, int]]:
    """Packs the files of ``src``, or of each folder in it (``column=value``), into files of about ``target_bytes`` at
    the same place under ``dst``. Gives ``{folder: (files before, files after)}``. All files have one schema, which is
    read from one of them if it isn't given.

    Defined cases: rows come out as often as they came in, nulls and all; an empty folder gives none; a folder with
    files as well as folders is refused; a destination that exists is replaced as a whole, once all new files are known
    to be right. Rows that fail the check raise ``VerificationError`` and leave the destination untouched. Of a run that
    ended between the two renames that replace it, the old files lie beside the destination and are put back first.
    """
    dst = dst.rstrip("/")
    fs, at = _fs(spark, dst)
    if not fs.exists(at) and fs.exists(_fs(spark, dst + "_replaced")[1]):
        fs.rename(_fs(spark, dst + "_replaced")[1], at)
    folders = sub_folders(spark, src)
    if folders and file_sizes(spark, src):
        raise ValueError(f"{src} has both files and folders")
    folders = folders or [""]
    sizes = {f: file_sizes(spark, f"{src}/{f}") for f in folders}
    full = [f for f in folders if sizes[f]]
    done = {f: (0, 0) for f in folders}
    if not full:
        return done
    if schema is None:
        schema = spark.read.format(fmt).load(f"{src}/{full[0]}").schema
    staged, new = dst + "_staged", dst + "_new"
    try:
        with packed_splits(spark, target_bytes, open_cost):
            for k in range(0, len(full), AT_ONCE):
                _pack(spark, src, f"{staged}/{k}", full[k : k + AT_ONCE], sizes, target_bytes, fmt, schema)
        fs.delete(_fs(spark, new)[1], True)
        for n, f in enumerate(full):
            p = _fs(spark, f"{new}/{f}" if f else new)[1]
            fs.mkdirs(p.getParent())
            part = _fs(spark, f"{staged}/{n // AT_ONCE * AT_ONCE}/__folder={n % AT_ONCE}")[1]
            if not fs.exists(part):  # files without rows
                spark.createDataFrame([], schema).write.format(fmt).save(part.toString())
            if not fs.rename(part, p):
                raise VerificationError(f"could not move {part} to {p}")
        _swap(spark, new, dst)
    finally:
        for left in (staged, new):
            fs.delete(_fs(spark, left)[1], True)
    return done | {f: (len(sizes[f]), len(file_sizes(spark, f"{dst}/{f}" if f else dst))) for f in full}


def first_occurrences(df: DataFrame, same: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows that agree in ``same`` (nulls agree with nulls) the least by ``order``; gives those columns. Aggregates
    on the map side, so that content that makes up a third of all rows is not gathered anywhere."""
    rows = df.select(*same, F.struct(*[F.col(c).alias(f"o{n}") for n, c in enumerate(order)]).alias("__first"))
    return rows.groupBy(*same).agg(F.min("__first").alias("__first")).select(
        *same, *[F.col(f"__first.o{n}").alias(c) for n, c in enumerate(order)]
    )


#: Files with at least so many valid bytes stay as they are.
SMALL_FILE_BYTES = 8192
#: Suffixes of published spool files; case matters.
PUBLISHED = (".saved", ".saved.gz")


def valid_source_records(df: DataFrame) -> DataFrame:
    """Rows with a table name that is not null, empty or U+0000, and a log that is neither null nor empty."""
    return df.where((F.col("table_name") != "") & (F.col("table_name") != "\0") & (F.octet_length("log_bytes") > 0))


def published_files(files: DataFrame) -> DataFrame:
    """``file_no`` of the listed files whose writing has ended."""
    path = F.col("file_path")
    return files.where(F.col("file_no").isNotNull() & (path.endswith(PUBLISHED[0]) | path.endswith(PUBLISHED[1]))).select("file_no").distinct()


#: A line of a small file: a record as JSON, bytes in base64.
SPOOL_SCHEMA = "pos int, table_name string, id_kind tinyint, id_int int, id_str string, log_bytes binary, ts bigint"


def consolidate_spool(
    spark: SparkSession,
    spool: str,
    files: DataFrame,
    out: str,
    target_bytes: int = TARGET_BYTES,
    open_cost: int = OPEN_COST,
    small_bytes: int = SMALL_FILE_BYTES,
) -> DataFrame:
    """Every valid record of a published spool file exactly once, in few files a ``table_name`` under ``out/packed``.

    ``spool`` holds the small files, in folders as it may be, each named by its number (``file_no.json``), with records
    as JSON lines (``SPOOL_SCHEMA``). They are read in packed splits and what is valid is written as few files, without a shuffle, and checked (``gather_files``). Only
    of these is it settled which records count: equal ones (key, ts, log) are kept where they occur first, by file, then
    position. That compares all records and is a shuffle; its output, a file a task and table, is packed again by
    ``pack_small_files``. The result is read from the packed files: they hold ``file_no, pos``, the record and
    ``small``, whether the valid logs of its file, repeats included, make fewer than ``small_bytes``.

    Defined cases: records of files that aren't listed, aren't published or have a null path don't count; a file
    listed twice counts once; null ids are an id like any other; an empty spool gives an empty result with the same
    columns; extra columns are left out.
    """
    listed = published_files(files)
    fs, at = _fs(spark, spool)
    if not fs.exists(at):
        fs.mkdirs(at)
    with packed_splits(spark, target_bytes, open_cost):
        raw = spark.read.schema(SPOOL_SCHEMA).option("recursiveFileLookup", "true").json(spool)
        number = F.nullif(F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9]+)\.json", 1), F.lit("")).cast("bigint")
        raw = valid_source_records(raw.select("*", number.alias("file_no")))
        few = broadcast_if_small(listed)
        if few is not listed:  # small enough to be sent around, so that others' records aren't written
            raw = raw.join(few, "file_no", "left_semi")
        valid = gather_files(raw, f"{out}/gathered")
    # one join by file tells both whether a record counts and whether its file is small
    sums = valid.groupBy("file_no").agg(F.sum(F.octet_length("log_bytes")).alias("valid_bytes"))
    info = sums.join(listed, "file_no", "left_semi").select("file_no", (F.col("valid_bytes") < small_bytes).alias("small"))
    same = ["table_name", "id_kind", "id_int", "id_str", "ts", "log_bytes"]
    counted = first_occurrences(valid.join(info, "file_no"), same, ["file_no", "pos", "small"])
    fragments, packed = f"{out}/fragments", f"{out}/packed"
    # a copy of the name stays in the file: folder names are escaped, and read back as numbers where they look so
    counted.withColumn("folder", F.col("table_name")).write.partitionBy("folder").parquet(fragments)
    pack_small_files(spark, fragments, packed, target_bytes, open_cost, schema=counted.schema)
    for left in (fragments, f"{out}/gathered"):
        fs.delete(_fs(spark, left)[1], True)
    if not fs.exists(_fs(spark, packed)[1]):
        spark.createDataFrame([], counted.schema).write.parquet(packed)
    return spark.read.schema(counted.schema).option("recursiveFileLookup", "true").parquet(packed)
