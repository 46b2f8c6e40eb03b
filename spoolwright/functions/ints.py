"""32-bit integer arithmetic on the JVM, for values that must agree bit by bit with stored ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def wrap32(x: Column) -> Column:
    """The low 32 bits of a bigint as a signed int; a plain cast would fail on overflow in ANSI mode."""
    return (x.bitwiseAND(F.lit(MASK)).bitwiseXOR(F.lit(0x80000000)) - F.lit(0x80000000)).cast("int")


def fold_timestamp(ts: Column) -> Column:
    """High half xor low half of a bigint, as a signed int."""
    return wrap32(F.shiftright(ts, 32).bitwiseXOR(ts))


def reverse_bits32(x: Column) -> Column:
    """The bits of an int in reverse order, as a signed int."""
    bits = F.lpad(F.bin(x.cast("bigint").bitwiseAND(F.lit(MASK))), 32, "0")
    return wrap32(F.conv(F.reverse(bits), 2, 10).cast("bigint"))


def table_plus_id(table_id: Column, id_hash: Column) -> Column:
    """A table's number and an identifier's hash as one int."""
    return reverse_bits32(table_id).bitwiseXOR(id_hash)


def pack_key(high: Column, low: Column) -> Column:
    """Two ints as one bigint. The low one is sign-extended: if it is negative, the high half is lost."""
    return F.shiftleft(high.cast("bigint"), 32).bitwiseOR(low.cast("bigint"))


def pack_offset(high: Column, offset: Column) -> Column:
    """An int and an offset, which is never negative, as one bigint."""
    return pack_key(high, offset)


def unpack_offset(packed: Column) -> tuple[Column, Column]:
    return F.shiftright(packed, 32).cast("int"), packed.bitwiseAND(F.lit(MASK)).cast("int")


def uint29_size(n: Column) -> Column:
    """Bytes that a length takes in the stored formats."""
    return F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).otherwise(4)


def id_size(kind: Column, id_str: Column) -> Column:
    """Bytes that an identifier takes: a marker, and an int or a length and the text."""
    n = F.octet_length(id_str)
    return F.when(kind == 1, F.lit(5)).when(kind == 2, 1 + uint29_size(n) + n).otherwise(F.lit(1))


def record_size(table: Column, kind: Column, id_str: Column, data: Column) -> Column:
    """Bytes that a record takes in a segment file: 8 for the time, table, identifier, data."""
    t, d = F.octet_length(table), F.octet_length(data)
    return F.lit(8) + uint29_size(t) + t + id_size(kind, id_str) + uint29_size(d) + d
