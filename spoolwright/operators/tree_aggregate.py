"""Per-key results when a few keys hold most rows.

A plain ``groupBy(key)`` sends one partial state per map task and key to the key's one reducer; with a hundred
thousand map tasks a hot key's reducer then merges a hundred thousand partials. Here the merge is a tree:

1. every input chunk (the rows of one task, whose size the engine fixes by ``maxPartitionBytes`` or by the advisory
   partition size) is combined where it lies, by the map side of the first aggregate;
2. chunks are numbered, and round *r* merges the states of ``fan_in`` neighbours, grouping by (key, number div
   ``fan_in ** r``), so that no reducer gets more than ``fan_in`` states of a key;
3. after ``ceil(log(chunks, fan_in))`` rounds one state a key is left.

A chunk's number is its task's partition number. Rows come to partitions by hash or by split, so a task that is run
again combines the same rows under the same number, and nothing is lost or counted twice.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For each measure how a chunk's rows make a state, and how states merge. All states are fixed in size.
_LEAF = {"count": lambda c: F.count(c), "sum": lambda c: F.sum(c), "min": lambda c: F.min(c), "max": lambda c: F.max(c)}
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def rounds(chunks: int, fan_in: int) -> int:
    """Merge rounds for that many chunks."""
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    return max(1, math.ceil(round(math.log(max(chunks, 1), fan_in), 9)))


def plan_chunks(df: DataFrame) -> int:
    """The most tasks that can end ``df``'s plan: the splits of its scans, by bytes and files as the engine packs them,
    or ``spark.sql.shuffle.partitions`` if that is more. The plan is made, nothing is run."""
    spark = df.sparkSession
    conf = spark._jsparkSession.sessionState().conf()
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    scanned = sum(n for n in sizes if n < 2**62)  # the engine's word for an unknown size, that of data in memory
    files = len(df._jdf.inputFiles())
    splits = -(-(scanned + files * conf.filesOpenCostInBytes()) // conf.filesMaxPartitionBytes())
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, splits)


def tree_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, tuple[str, str | Column]],
    fan_in: int = 8,
    chunks: int | None = None,
) -> DataFrame:
    """One row for each distinct value of ``keys`` with the ``measures``, ``{name: (count|sum|min|max, column)}``.

    ``chunks`` is how many tasks read ``df``; unset, it is found by ``plan_chunks``.

    Defined cases: null keys are a group of their own, as in SQL; ``count`` counts non-null values, and ``min``,
    ``max`` and ``sum`` of nothing but nulls are null; repeated rows count as often as they occur; an empty table
    gives no rows; columns other than the keys and those measured are not read, so their names may be anything,
    also that of a measure.
    """
    bad = {op for op, _ in measures.values()} - set(_LEAF)
    if bad or set(keys) & set(measures):
        raise ValueError(f"unknown measures {bad} or a measure named as a key")
    if chunks is None:
        chunks = plan_chunks(df)
    todo = rounds(chunks, fan_in)
    # positional names inside, so that no column of the input can clash
    ks = [f"k{i}" for i in range(len(keys))]
    ms = [f"m{i}" for i in range(len(measures))]
    ops = [op for op, _ in measures.values()]
    state = df.select(
        *[F.col(k).alias(a) for k, a in zip(keys, ks)],
        *[(F.col(c) if isinstance(c, str) else c).alias(a) for (_, c), a in zip(measures.values(), ms)],
        F.floor(F.spark_partition_id() / fan_in).alias("node"),
    )
    for r in range(todo):
        how = _LEAF if r == 0 else _MERGE
        by = ks if r == todo - 1 else [*ks, "node"]
        state = state.groupBy(*by).agg(*[how[op](F.col(m)).alias(m) for op, m in zip(ops, ms)])
        if r < todo - 1:
            state = state.withColumn("node", F.floor(F.col("node") / fan_in))
    return state.select(*[F.col(a).alias(k) for k, a in zip(keys, ks)], *[F.col(a).alias(m) for m, a in zip(measures, ms)])
