"""Segments: their numbers, statistics and offsets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ints import record_size
from ..functions.strings import zero_pad
from .numbering import numbered

MAX_RECORDS = 2_000_000
MAX_BYTES = 2_147_483_647
HEAD_BYTES = 64
VERSION = 2
NO_MIN, NO_MAX = 2**63 - 1, 0


def segment_name(segment: Column, suffix: str = ".record") -> Column:
    return F.concat(zero_pad(segment, 3), F.lit(suffix))


def segment_of(n: Column, max_records: int) -> Column:
    """Segment, from 1, of the record with number ``n``, from 0, if records alone count."""
    return (F.floor(n / max_records) + 1).cast("int")


def stats(log: DataFrame, by: str = "segment") -> DataFrame:
    """For each segment: records, distinct records, least and greatest time, bytes."""
    return log.groupBy(by).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("table_name", "id_key", "timestamp", "data").alias("hashes"),
        F.min("timestamp").alias("min_timestamp"),
        F.max("timestamp").alias("max_timestamp"),
        F.sum(record_size(F.col("table_name"), F.col("id_kind"), F.col("id_str"), F.col("data"))).alias("total_bytes"),
    )


def info_lines(info: DataFrame) -> DataFrame:
    """One line of text for each row of segment information, in order of name."""

    def when(c: str) -> Column:
        return F.date_format(F.timestamp_millis(c), "yy-MM-dd_HH:mm:ss")

    line = F.format_string(
        "%s: r/o:%d v:%d records:%d headers:%d hashes:%d minTS:%s maxTS:%s",
        F.col("name"), F.col("read_only").cast("int"), F.col("head_version"), F.col("records"), F.col("headers"), F.col("hashes"),
        when("min_timestamp"), when("max_timestamp"),
    )
    return info.orderBy("name").select("name", line.alias("line"))


def with_offsets(log: DataFrame) -> DataFrame:
    """``log`` (with ``segment`` and ``seq``) with each record's ``size`` and ``byte_offset`` in its segment's file. A
    segment has at most ``MAX_RECORDS`` records, which bounds the window."""
    size = record_size(F.col("table_name"), F.col("id_kind"), F.col("id_str"), F.col("data"))
    before = Window.partitionBy("segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("size", size).withColumn("byte_offset", F.coalesce(F.sum("size").over(before), F.lit(0)) + HEAD_BYTES)


#: Sizes handed on in one row, few enough for a batch of 10,000 rows; what stands for a null among them.
RUN, UNKNOWN = 256, -1


def roll_segments(
    log: DataFrame,
    order: list[str],
    max_records: int = MAX_RECORDS,
    max_bytes: int = MAX_BYTES,
    first_segment: int = 1,
    used_records: int = 0,
    used_bytes: int = HEAD_BYTES,
) -> DataFrame:
    """``log`` with ``n`` (number in order, from 0), ``size`` (bytes) and ``segment``: a segment is left when it holds ``max_records`` or
    when the next record would pass ``max_bytes``. The first segment may be partly used.

    Where records alone fill segments, a segment follows from a record's number. Where bytes do, a cut depends on the
    one before: one task goes through the sizes, four bytes a record, which others have sorted and packed; the cuts, a
    number for each segment, go to the rows. A record of more bytes than a segment takes has one of its own; behind a record
    of unknown size its segment is left by number alone.
    """
    size = record_size(F.col("table_name"), F.col("id_kind"), F.col("id_str"), F.col("data"))
    rows = numbered(log.withColumn("size", size), order, "n")
    total, all_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if used_bytes + all_bytes <= max_bytes or total == 0:
        n = F.col("n") + used_records
        if used_records >= max_records:  # the first one is full
            n, first_segment = F.col("n"), first_segment + 1
        return rows.withColumn("segment", (F.floor(n / max_records) + first_segment).cast("int"))
    runs = rows.select("n", F.col("size").cast("int")).mapInArrow(_runs, "n bigint, sizes binary").repartition(1).sortWithinPartitions("n")
    starts = runs.mapInArrow(_cuts(max_records, max_bytes, used_records, used_bytes), "n bigint").toArrow().column(0).to_numpy()

    def segment(n: pd.Series) -> pd.Series:
        return pd.Series(first_segment + np.searchsorted(starts, n.to_numpy(), "right"))

    return rows.withColumn("segment", F.pandas_udf(segment, "int")("n"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of records that follow each other as 32-bit numbers in one row, with the number of the first."""
    for b in batches:
        if not b.num_rows:
            continue
        n, sizes = b.column(0).to_numpy(), b.column(1).fill_null(UNKNOWN).to_numpy()
        by_n = np.argsort(n, kind="stable")  # mostly they are in order
        n, sizes = n[by_n], sizes[by_n].astype("<i4")
        at = np.flatnonzero((np.diff(n, prepend=-2) != 1) | (n % RUN == 0))
        yield pa.RecordBatch.from_arrays([pa.array(n[at]), pa.array([x.tobytes() for x in np.split(sizes, at[1:])], pa.binary())], ["n", "sizes"])


def _cuts(max_records: int, max_bytes: int, used_records: int, used_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Goes through the runs in order and gives the number of each record that begins a segment, but for the first one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, end = 0, 0  # number of the batch's first record, bytes before it
        n0, base, room_n, room_b = 0, 0, max_records - used_records, max_bytes - used_bytes
        fresh, unknown = used_records == 0 and used_bytes == HEAD_BYTES, False  # the segment was empty at n0; a size since n0 is unknown
        for b in batches:
            sizes = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4")
            if not len(sizes):
                continue
            ends = end + np.cumsum(np.maximum(sizes, 0), dtype=np.int64)
            gaps = np.flatnonzero(sizes == UNKNOWN)
            starts = []
            while True:
                least = max(n0 + fresh - first, 0)  # an empty segment takes any record
                at = max(n0 + room_n - first, least)
                by_bytes = max(int(np.searchsorted(ends, base + room_b, "right")), least)
                gap = np.searchsorted(gaps, max(n0 - first, 0))
                if not unknown and (gap == len(gaps) or by_bytes < gaps[gap]):
                    at = min(at, by_bytes)
                if at >= len(sizes):
                    unknown = unknown or gap < len(gaps)
                    break
                n0, base = first + at, int(ends[at - 1]) if at else end
                room_n, room_b, fresh, unknown = max_records, max_bytes - HEAD_BYTES, True, False
                starts.append(n0)
            first, end = first + len(sizes), int(ends[-1])
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64())], ["n"])

    return run
