"""Messages delivered more than once.

A hash aggregation by identifier keeps, with ``min_by`` over a struct of delivery time and tie-break, the first
delivery of each. The struct goes in as one number of fixed width, as Spark would sort, not hash, for a struct. The map side already reduces every task's copies to one, so a message that makes up a third of all
rows reaches its reducer as one row per task. Where a message is long, its identifier holds a 16-byte digest of its
text in place of the text; that and the identifiers are all that is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import digest, log_text
from ..schema import KEY


#: Types that fit a field of a fixed-width aggregation buffer; only such buffers are kept in Spark's hash table.
_FIXED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_LAST = 2**63 - 1


def _order(at: T.DataType, ties: list[T.DataType]) -> Column:
    """The struct (no delivery time, delivery time, tie-breaks) to be least, packed into one number where that orders
    alike: a long, or a decimal of 38 digits with the time above the tie-break. Unpacked, it makes Spark sort."""
    if not ties and isinstance(at, _INTEGRAL):
        return F.coalesce(F.col("at").cast("bigint"), F.lit(_LAST))
    if len(ties) == 1 and isinstance(ties[0], _INTEGRAL) and isinstance(at, (T.TimestampType, T.ByteType, T.ShortType, T.IntegerType)):
        time = F.unix_micros("at") if isinstance(at, T.TimestampType) else F.col("at").cast("bigint")  # below 2**59
        time = F.coalesce(time, F.lit(2**60)).cast("decimal(19,0)")
        return time * F.lit(str(2**64)).cast("decimal(20,0)") + F.coalesce(F.col("t0").cast("bigint"), F.lit(-(2**63))).cast("decimal(19,0)")
    return F.struct(F.col("at").isNull().alias("late"), "at", *[f"t{n}" for n in range(len(ties))])


def first_deliveries(
    df: DataFrame,
    identifier: Sequence[str | Column],
    delivered: Column,
    tie_break: Sequence[Column],
    keep: Sequence[str],
) -> DataFrame:
    """The ``keep`` columns of the first delivery of each message.

    Rows are one message if all of ``identifier`` (columns by name, or expressions) are equal, nulls being equal to
    nulls. First is the row with the least ``delivered``, rows without one coming last, then the least ``tie_break``.
    Give a tie-break that is unique in a message (none is needed if ``delivered`` is), else equal rows leave it open
    which is kept (one is, always). An empty table gives no rows. No other columns are read.

    What is kept and part of the identifier comes from the group. With at most one more column, of fixed width, and an
    integer to order by, or a time and an integer, the aggregation is by hash; else Spark sorts.
    """
    ids = {f"i{n}": c for n, c in enumerate(identifier)}
    of_group = {c: n for n, c in ids.items() if isinstance(c, str)}
    rest = [c for c in keep if c not in of_group]
    rows = df.select(
        *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in ids.items()],
        delivered.alias("at"),
        *[c.alias(f"t{n}") for n, c in enumerate(tie_break)],
        *[F.col(c).alias(f"c{n}") for n, c in enumerate(rest)],
    )
    kinds = {f.name: f.dataType for f in rows.schema}
    order = _order(kinds["at"], [kinds[f"t{n}"] for n in range(len(tie_break))])
    if len(rest) == 1 and isinstance(kinds["c0"], _FIXED):
        value, out = F.col("c0"), {rest[0]: F.col("p")}
    else:
        value, out = F.struct(F.lit(1), *[f"c{n}" for n in range(len(rest))]), {c: F.col(f"p.c{n}") for n, c in enumerate(rest)}
    if rest:
        first = rows.groupBy(*ids).agg(F.min_by(value, order).alias("p"))
    else:
        first = rows.select(*ids).distinct()
    return first.select(*[(F.col(of_group[c]) if c in of_group else out[c]).alias(c) for c in keep])


def repeated_deliveries(df: DataFrame, identifier: Sequence[str | Column], row_id: str) -> DataFrame:
    """``row_id`` of every row that is not the first delivery of its message, first being the least ``row_id``.

    ``row_id`` must be unique; the anti join on it is therefore free of skew whatever the copies. Rows without a
    ``row_id`` cannot be named and are left out. ``df`` is read twice: once for the identifiers, once for ``row_id``
    alone.
    """
    known = df.where(F.col(row_id).isNotNull())
    first = first_deliveries(known, identifier, F.col(row_id), [], [row_id])
    return known.select(row_id).join(first, row_id, "left_anti")


def message_identity(text: Column | None = None, ts: str = "ts") -> list[str | Column]:
    """Identifier of a log message: its key, time and text. Records that say the same in different encodings are the
    same message. The text goes in as a digest; missing data differs from empty data."""
    text = log_text(F.col("data")) if text is None else text
    return [*KEY, ts, digest(text)]
