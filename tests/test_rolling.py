"""Rolling by bytes beside a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from spoolwright.operators.segments import HEAD_BYTES, roll_segments
from spoolwright.session import conf

SCHEMA = "table_name string, id_kind tinyint, id_int int, id_str string, timestamp bigint, data binary, pos bigint"


def frame(spark, lengths):
    """A record for each length of its data; one of unknown length for None."""
    rows = [("t", 1, 1, None, 1, None if n is None else b"x" * n, k) for k, n in enumerate(lengths)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def looped(lengths, max_records, max_bytes, segment=1, held=0, used=HEAD_BYTES):
    out, began = [], held > 0 or used > HEAD_BYTES
    for n in lengths:
        size = None if n is None else 8 + 2 + 5 + (1 if n < 128 else 2) + n
        if began and (held >= max_records or None not in (used, size) and used + size > max_bytes):
            segment, held, used = segment + 1, 0, HEAD_BYTES
        began, held, used = True, held + 1, None if None in (used, size) else used + size
        out.append(segment)
    return out


def rolled(df, *args):
    return [r.segment for r in roll_segments(df, ["pos"], *args).orderBy("n").collect()]


def jobs(spark, group, f):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return f(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_segments(spark):
    r = random.Random(2)
    lengths = [r.randrange(200) for _ in range(600)]
    df = frame(spark, lengths)
    few, a = jobs(spark, "few", lambda: rolled(df, 300, 30_000))
    many, b = jobs(spark, "many", lambda: rolled(df, 9, 400))
    assert few == looped(lengths, 300, 30_000) and many == looped(lengths, 9, 400)
    assert few[-1] < 6 and many[-1] > 100 and abs(a - b) <= 2


@pytest.mark.parametrize("rows", [7, 10_000])
@pytest.mark.parametrize("args", [(9, 400), (5, 64), (1, 500), (50, 700), (50, 700, 4, 3, 600), (50, 700, 4, 50, 300), (50, 700, 4, 2, 900)])
def test_cuts(spark, rows, args):
    """Batches and runs that end anywhere; records that a segment doesn't take; a first segment that is used, full or over-full."""
    r = random.Random(3)
    lengths = [r.choice([0, r.randrange(100), r.randrange(300), 900 if r.random() < 0.1 else 5]) for _ in range(2500)]
    with conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch=rows):
        assert rolled(frame(spark, lengths), *args) == looped(lengths, *args)


@pytest.mark.parametrize("rows", [7, 10_000])
def test_unknown_sizes(spark, rows):
    """As in SQL, where a sum with a null is null until a segment begins anew."""
    r = random.Random(4)
    lengths = [None if r.random() < 0.04 else r.randrange(300) for _ in range(1500)]
    with conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch=rows):
        assert rolled(frame(spark, lengths), 20, 1500) == looped(lengths, 20, 1500)


def test_nothing_to_roll(spark):
    assert rolled(frame(spark, [1]).where(F.lit(False)), 5, 100) == []
    assert rolled(frame(spark, [1, 2, 300]), 5, 64) == [1, 2, 3]
