"""Adaptive typed arrays: the narrowest of seven encodings that holds all values, widened as values come."""

from __future__ import annotations

import struct
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codec import FormatError

MAX_SIZE = 1024
INT_MIN, INT_MAX = -(2**31), 2**31 - 1
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


class Encoding(IntEnum):
    EMPTY_LONG = 1
    LONG = 2
    INT_LONG = 3
    EMPTY_STRING = 4
    STRING = 5
    INT_STRING = 6
    LONG_STRING = 7


#: Encodings of one type from narrow to wide.
WIDER = [[Encoding.EMPTY_LONG, Encoding.INT_LONG, Encoding.LONG], [Encoding.EMPTY_STRING, Encoding.INT_STRING, Encoding.LONG_STRING, Encoding.STRING]]


def encoding_of(value: int | str) -> Encoding:
    """The narrowest encoding of one value. A string counts as a number only if the number prints the same, and never
    as the least number, which stands for the empty string."""
    if isinstance(value, int):
        return Encoding.EMPTY_LONG if value == 0 else Encoding.INT_LONG if INT_MIN <= value <= INT_MAX else Encoding.LONG
    if not value:
        return Encoding.EMPTY_STRING
    digits = value.removeprefix("-")
    if not (digits.isascii() and digits.isdigit() and str(int(value)) == value):
        return Encoding.STRING
    n = int(value)
    return Encoding.INT_STRING if INT_MIN < n <= INT_MAX else Encoding.LONG_STRING if LONG_MIN < n <= LONG_MAX else Encoding.STRING


def widest(encodings: list[Encoding]) -> Encoding:
    for row in WIDER:
        if all(e in row for e in encodings):
            return row[max(row.index(e) for e in encodings)]
    raise ValueError("values of two types")


class AdaptiveArray:
    """Values of one type, up to 1024. ``add`` widens the encoding where a value asks for it."""

    def __init__(self, values: list | tuple = (), encoding: Encoding | None = None):
        self.values: list = []
        self.encoding = encoding
        for v in values:
            self.add(v)

    def add(self, value: int | str) -> Encoding:
        if len(self.values) >= MAX_SIZE:
            raise OverflowError(f"more than {MAX_SIZE} values")
        own = encoding_of(value)
        self.encoding = own if self.encoding is None else widest([self.encoding, own])
        self.values.append(value)
        return self.encoding

    def __getitem__(self, i: int) -> int | str:
        if not 0 <= i < len(self.values):
            raise IndexError(f"index {i}")
        return self.values[i]

    def __len__(self) -> int:
        return len(self.values)

    def to_bytes(self) -> bytes:
        """Encoding and size as 16-bit numbers, then the values."""
        e, n = self.encoding, len(self.values)
        if e is None:
            raise ValueError("nothing was added")
        head = struct.pack(">hh", e, n)
        if e in (Encoding.EMPTY_LONG, Encoding.EMPTY_STRING):
            return head
        if e == Encoding.STRING:
            return head + b"".join(len(b).to_bytes(4, "big") + b for b in (v.encode() for v in self.values))
        kind, least = (">%di", INT_MIN) if e in (Encoding.INT_LONG, Encoding.INT_STRING) else (">%dq", LONG_MIN)
        return head + struct.pack(kind % n, *[v if isinstance(v, int) else int(v) if v else least for v in self.values])

    @classmethod
    def from_bytes(cls, b: bytes) -> AdaptiveArray:
        e, n = struct.unpack(">hh", b[:4])
        if not 0 <= n <= MAX_SIZE:
            raise FormatError(f"size {n}")
        e, body = Encoding(e), b[4:]
        out = cls(encoding=e)
        if e == Encoding.EMPTY_LONG:
            out.values = [0] * n
        elif e == Encoding.EMPTY_STRING:
            out.values = [""] * n
        elif e == Encoding.STRING:
            at = 0
            for _ in range(n):
                k = int.from_bytes(body[at : at + 4], "big")
                out.values.append(body[at + 4 : at + 4 + k].decode())
                at += 4 + k
        else:
            kind, least = (">%di", INT_MIN) if e in (Encoding.INT_LONG, Encoding.INT_STRING) else (">%dq", LONG_MIN)
            numbers = struct.unpack_from(kind % n, body)
            text = e in (Encoding.INT_STRING, Encoding.LONG_STRING)
            out.values = [("" if v == least else str(v)) if text else v for v in numbers]
        return out


def encoding_of_long(c: Column) -> Column:
    """Name of the narrowest encoding of a bigint."""
    return F.when(c == 0, "EMPTY_LONG").when(c.between(INT_MIN, INT_MAX), "INT_LONG").when(c.isNotNull(), "LONG")


def encoding_of_string(c: Column) -> Column:
    """Name of the narrowest encoding of a string."""
    n = F.when(c.rlike("^-?[0-9]+$"), c.try_cast("bigint"))
    whole = F.coalesce(n.cast("string") == c, F.lit(False))
    return (
        F.when(c == "", "EMPTY_STRING")
        .when(whole & (n > INT_MIN) & (n <= INT_MAX), "INT_STRING")
        .when(whole & (n > F.lit(LONG_MIN)), "LONG_STRING")
        .when(c.isNotNull(), "STRING")
    )


def collected(df: DataFrame, key: str, seq: str, value: str, encoding: Column) -> DataFrame:
    """For each key all its values in order of ``seq``, their number, and the encoding that holds them all. A key of more
    than 1024 values fails, as adding to a full array does. The numbers are held against that by a filter, whatever is
    read of the result; what is gathered of a key until then is bounded: chunks of its rows are cut to 1024 first."""
    from pyspark.sql import Window

    rank = {name: i for row in WIDER for i, name in enumerate(e.name for e in row)}
    level = F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])
    rows = df.select(F.col(key).alias("k"), F.col(seq).alias("s"), F.col(value).alias("v"), encoding.alias("e"))
    rows = rows.where(F.col("v").isNotNull()).withColumn("l", level[F.col("e")])
    wide = rows.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("l", "e"))["e"].alias("encoding"))
    full = F.raise_error(F.concat(F.lit(f"more than {MAX_SIZE} values: {key} "), F.coalesce(F.col("k").cast("string"), F.lit("null"))))
    wide = wide.where(F.when(F.col("size") > MAX_SIZE, full.cast("boolean")).otherwise(True))
    part = F.pmod(F.xxhash64("s"), F.lit(64))
    cut = rows.withColumn("c", part).withColumn("r", F.row_number().over(Window.partitionBy("k", "c").orderBy("s"))).where(F.col("r") <= MAX_SIZE)
    cut = cut.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("s"))).where(F.col("r") <= MAX_SIZE)
    lists = cut.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "v"))), lambda x: x["v"]).alias("vals"))
    return lists.join(wide, "k").select(F.col("k").alias(key), F.col("vals").alias("values"), "size", "encoding")
