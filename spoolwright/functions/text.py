"""Bytes to text, and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The upper half of windows-1251; its one unassigned byte becomes U+FFFD.
CP1251_HIGH = bytes(range(128, 256)).decode("cp1251", "replace")
LATIN1_HIGH = bytes(range(128, 256)).decode("latin-1")


def cp1251(data: Column) -> Column:
    """Windows-1251 bytes as text, on the JVM: one character per byte as ISO-8859-1, then the upper half mapped."""
    return F.translate(F.decode(data, "ISO-8859-1"), LATIN1_HIGH, CP1251_HIGH)


def log_text(data: Column, replacement_means_cp1251: bool = False) -> Column:
    """Text of a record: UTF-8, or windows-1251 if the bytes aren't valid UTF-8. Null stays null.

    With ``replacement_means_cp1251``, valid UTF-8 that holds U+FFFD itself is read as windows-1251 as well.
    """
    s = data.cast("string")
    good = F.is_valid_utf8(s)
    if replacement_means_cp1251:
        good = good & ~F.contains(s, F.lit("�"))
    return F.when(good, s).otherwise(cp1251(data))


def digest(*cols: Column) -> Column:
    """16 bytes of SHA-256 over the columns' text forms, each with its length, so that no two different rows share
    an input. Nulls differ from every value. Binary columns must be given as text or hex."""
    parts = []
    for c in cols:
        s = c.cast("string")
        parts += [F.coalesce(F.octet_length(s).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(s, F.lit(""))]
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def digest_bytes(c: Column) -> Column:
    """16 bytes of SHA-256 of a binary column; null stays null."""
    return F.substring(F.unhex(F.sha2(c, 256)), 1, 16)
