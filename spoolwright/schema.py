"""The record and its typed identifier.

An identifier is empty, a 32-bit integer or a string; the three never equal each other. It is kept as
``(id_kind, id_int, id_str)`` with the canonical, never-null text ``id_key``: ``''``, ``'i:5'`` or ``'s:5'``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMPTY, INT, STRING = 0, 1, 2

KEY = ["table_name", "id_kind", "id_int", "id_str"]

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("id_kind", T.ByteType()),
        T.StructField("id_int", T.IntegerType()),
        T.StructField("id_str", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("data", T.BinaryType()),
    ]
)

#: A stored record: ``seq`` is the order of arrival, which a DataFrame does not have by itself.
LOG_SCHEMA = T.StructType(
    [
        *RECORD_SCHEMA.fields,
        T.StructField("id_key", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("segment", T.IntegerType()),
    ]
)

#: What makes two records the same.
IDENTITY = ["table_name", "id_key", "timestamp", "data"]


def id_key(kind: Column | None = None, int_: Column | None = None, str_: Column | None = None) -> Column:
    kind = F.col("id_kind") if kind is None else kind
    int_ = F.col("id_int") if int_ is None else int_
    str_ = F.col("id_str") if str_ is None else str_
    return (
        F.when(kind == INT, F.concat(F.lit("i:"), F.coalesce(int_.cast("string"), F.lit(""))))
        .when(kind == STRING, F.concat(F.lit("s:"), F.coalesce(str_, F.lit(""))))
        .otherwise(F.lit(""))
    )


def with_id_key(df: DataFrame) -> DataFrame:
    return df.withColumn("id_key", id_key())


def id_text(kind: Column | None = None) -> Column:
    """The identifier as people write it; empty for the empty one."""
    return F.coalesce(F.col("id_int").cast("string"), F.col("id_str"), F.lit(""))


def parse_id(s: Column) -> tuple[Column, Column, Column]:
    """An identifier typed by a person: an integer if it is one of 32 bits (sign and leading zeros allowed, blanks
    not), else a string. Gives kind, integer and string."""
    as_int = F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("int"))
    return (
        F.when(as_int.isNotNull(), F.lit(INT)).otherwise(F.lit(STRING)).cast("tinyint"),
        as_int,
        F.when(as_int.isNull(), s),
    )


def parse_id_literal(s: str) -> str:
    """``id_key`` of an identifier typed by a person."""
    import re

    if re.fullmatch(r"[+-]?[0-9]+", s) and -(2**31) <= int(s) < 2**31:
        return f"i:{int(s)}"
    return f"s:{s}"
