"""Numbers in an order over all rows, without bringing them to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialise


def numbered(df: DataFrame, order: Sequence[str], number: str = "n", sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``number`` from 0 in ``order``, and for each ``{name: column}`` of ``sums`` the running sum of the
    column up to and with the row.

    Rows are range-partitioned and sorted, written, then numbered within partitions; one row for each partition is
    summed over them. ``order`` should be unique; among equals the numbers are any, but none comes twice.
    """
    sums = sums or {}
    part = F.shiftright(F.monotonically_increasing_id(), 33).cast("int")
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", part).withColumn("__nth", nth)
    sorted_ = materialise(sorted_, "numbered")
    totals = sorted_.groupBy("__part").agg(F.count(F.lit(1)).alias("__k"), *[F.sum(c).alias(f"__s_{s}") for s, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = totals.select(
        "__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ["__k", *[f"__s_{s}" for s in sums]]]
    )
    within = Window.partitionBy("__part").orderBy("__nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sorted_.join(broadcast_if_small(totals), "__part").withColumn(number, F.col("__k") + F.col("__nth"))
    for s, c in sums.items():
        out = out.withColumn(s, F.sum(c).over(within) + F.col(f"__s_{s}"))
    return out.drop("__part", "__nth", "__k", *[f"__s_{s}" for s in sums])
