"""Strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_controls(s: Column) -> Column:
    """Strips all characters up to U+0020 at both ends; Spark's ``trim`` strips blanks alone."""
    return F.regexp_replace(s, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def zero_pad(n: Column, width: int) -> Column:
    """At least ``width`` digits; longer numbers stay whole, negative ones fail."""
    return F.when(n < 0, F.raise_error(F.lit("a number to pad must not be negative"))).otherwise(F.format_string(f"%0{width}d", n))


def maybe_chop_ending(s: Column, ending: str) -> Column:
    """Without the ending, or null if it has another."""
    return F.when(F.endswith(s, F.lit(ending)), F.left(s, F.length(s) - len(ending)))


def normalized_table(t: Column) -> Column:
    """Without a leading ``ros.``. Never applied on ingest."""
    return F.regexp_replace(t, r"^ros\.", "")


def record_key(table: Column, id_text: Column) -> Column:
    return F.concat_ws("/", normalized_table(table), id_text)


def split_before(s: Column, delimiter: str) -> Column:
    """The pieces of a text, each but the first beginning with the delimiter. Delimiters are found from the left and
    don't overlap; a text that begins with one has an empty first piece."""
    # all but the first piece of a plain split lack the delimiter that was before them
    parts = F.split(s, _quoted(delimiter), -1)
    return F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(delimiter), p)))


def _quoted(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


#: Begin of each block of a legacy log after the first.
BLOCK = "\n\n---- "


def legacy_table(file_name: Column) -> Column:
    """Table of a legacy log, by its name: what is before the last ``.sql.``; null if there is none."""
    found = F.regexp_extract(file_name, r"^(.*)\.sql\.", 1)
    return F.when(file_name.rlike(r"^.*\.sql\."), found)


def legacy_fields(block: Column) -> tuple[Column, Column]:
    """Identifier (an int from the first line, or null) and time in ms of a trimmed block."""
    first = F.substring_index(block, "\n", 1)
    number = F.regexp_extract(first, r" id:(\d+)", 1)
    id_int = F.when(number != "", number.cast("int"))
    return id_int, F.unix_millis(F.to_timestamp(F.substring(block, 6, 19), "yyyy-MM-dd HH:mm:ss"))
