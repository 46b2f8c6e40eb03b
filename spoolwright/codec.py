"""Byte layouts: lengths, identifiers, spool files and segment files. Plain Python; used inside Arrow batches."""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator

SAVED_VERSION = 2
RECORD_VERSION = 2
RECORD_HEAD = 64
MAX_FIELD = 1 << 20
UINT29_LIMIT = 1 << 30

Record = tuple[str, int, "int | None", "str | None", int, bytes]  # table, kind, int, string, ts, data


class FormatError(ValueError):
    """Bytes that are not what they should be."""


def uint29_bytes(n: int) -> bytes:
    """A length in one to four bytes: 7 bits a byte, high bit set if more follow, and 8 bits in a fourth."""
    if n < 0 or n >= UINT29_LIMIT:
        raise FormatError(f"length {n}")
    if n < 1 << 7:
        return bytes((n,))
    if n < 1 << 14:
        return bytes((n >> 7 | 0x80, n & 0x7F))
    if n < 1 << 21:
        return bytes((n >> 14 | 0x80, n >> 7 & 0x7F | 0x80, n & 0x7F))
    return bytes((n >> 22 & 0x7F | 0x80, n >> 15 & 0x7F | 0x80, n >> 8 & 0x7F | 0x80, n & 0xFF))


def read_exact(f: io.BufferedIOBase, n: int) -> bytes:
    b = f.read(n)
    if len(b) != n:
        raise EOFError(f"{n} bytes wanted, {len(b)} left")
    return b


def read_uint29(f: io.BufferedIOBase) -> int:
    n = 0
    for i in range(4):
        b = read_exact(f, 1)[0]
        if i == 3:
            return n << 8 | b
        n = n << 7 | b & 0x7F
        if b < 0x80:
            return n
    raise AssertionError


def read_field(f: io.BufferedIOBase) -> bytes:
    n = read_uint29(f)
    if n > MAX_FIELD:
        raise FormatError(f"field of {n} bytes")
    return read_exact(f, n)


def field_bytes(b: bytes) -> bytes:
    if len(b) > MAX_FIELD:
        raise FormatError(f"field of {len(b)} bytes")
    return uint29_bytes(len(b)) + b


def id_bytes(kind: int, number: int | None, text: str | None) -> bytes:
    if kind == 0:
        return b"\0"
    if kind == 1:
        return b"\1" + struct.pack(">i", number)
    b = text.encode()
    return b"\2" + uint29_bytes(len(b)) + b


def read_id(f: io.BufferedIOBase) -> tuple[int, int | None, str | None]:
    kind = read_exact(f, 1)[0]
    if kind == 0:
        return 0, None, None
    if kind == 1:
        return 1, struct.unpack(">i", read_exact(f, 4))[0], None
    if kind == 2:
        return 2, None, read_field(f).decode("utf-8", "replace")
    raise FormatError(f"identifier marker {kind}")


def prefix_int(n: int) -> bytes:
    """A 32-bit integer in one to five bytes whose first bits tell how many follow."""
    n &= 0xFFFFFFFF
    for size, prefix in ((1, 0x00), (2, 0x80), (3, 0xC0), (4, 0xE0)):
        if n < 1 << 7 * size:
            return (n | prefix << 8 * (size - 1)).to_bytes(size, "big")
    return b"\xff" + n.to_bytes(4, "big")


def read_prefix_int(f: io.BufferedIOBase) -> int:
    b = read_exact(f, 1)[0]
    more = 4 if b == 0xFF else 3 if b >= 0xE0 else 2 if b >= 0xC0 else 1 if b >= 0x80 else 0
    head = 0 if more == 4 else b & (0x7F >> more)
    n = int.from_bytes(bytes((head,)) + read_exact(f, more), "big")
    return n - (1 << 32) if n >= 1 << 31 else n


def prefix_string(s: str) -> bytes:
    b = s.encode()
    return prefix_int(len(b)) + b


def read_prefix_string(f: io.BufferedIOBase) -> str:
    return read_exact(f, read_prefix_int(f)).decode()


def unzip(content: bytes, name: str) -> bytes:
    return gzip.decompress(content) if name.endswith(".gz") else content


def saved_record(table: str, kind: int, number: int | None, text: str | None, ts: int, log: bytes) -> bytes:
    t = table.encode()
    return uint29_bytes(len(t)) + t + id_bytes(kind, number, text) + struct.pack(">q", ts) + uint29_bytes(len(log)) + log


def saved_file(records: Iterator[Record] | list[Record]) -> bytes:
    return struct.pack(">i", SAVED_VERSION) + b"".join(saved_record(*r) for r in records)


def read_saved(content: bytes, path: str = "") -> Iterator[Record]:
    """Records of a spool file. The log is read as UTF-8 and kept as such, bad bytes replaced by U+FFFD. Anything
    wrong raises ``FormatError`` with path and position."""
    f = io.BytesIO(unzip(content, path))
    try:
        version = struct.unpack(">i", read_exact(f, 4))[0]
        if version != SAVED_VERSION:
            raise FormatError(f"version {version}")
        end = len(f.getbuffer())
        while f.tell() < end:
            table = read_field(f).decode("utf-8", "replace")
            if table in ("", "\0"):
                raise FormatError("empty table name")
            kind, number, text = read_id(f)
            ts = struct.unpack(">q", read_exact(f, 8))[0]
            log = read_field(f)
            if not log:
                raise FormatError("empty log")
            yield table, kind, number, text, ts, log.decode("utf-8", "replace").encode()
    except (EOFError, FormatError) as e:
        raise FormatError(f"{path}, at {f.tell()}: {e}") from e


def segment_record(table: str, kind: int, number: int | None, text: str | None, ts: int, data: bytes) -> bytes:
    return struct.pack(">q", ts) + field_bytes(table.encode()) + id_bytes(kind, number, text) + field_bytes(data)


def segment_file(records: list[Record]) -> bytes:
    """A segment file: a head of 64 bytes with version, size, least and greatest time and count, then the records."""
    body = b"".join(segment_record(*r) for r in records)
    times = [r[4] for r in records]
    return segment_head_bytes(RECORD_HEAD + len(body), min(times, default=2**63 - 1), max([0, *times]), len(records)) + body


def segment_head_bytes(total: int, lo: int, hi: int, n: int) -> bytes:
    return struct.pack(">iqqqi", RECORD_VERSION, total, lo, hi, n).ljust(RECORD_HEAD, b"\0")


def segment_head(content: bytes) -> dict:
    v, total, lo, hi, n = struct.unpack(">iqqqi", content[:32])
    if v != RECORD_VERSION:
        raise FormatError(f"version {v}")
    return {"version": v, "total_bytes": total, "min_ts": lo, "max_ts": hi, "records": n}


def read_segment(content: bytes | io.BufferedIOBase, path: str = "") -> Iterator[tuple[int, Record]]:
    """Offset and record of each record of a segment file, whatever its head says of their number, as bytes or as an
    open file, which is read as it goes. A last record that is cut off is dropped, as a crash leaves it."""
    f = io.BytesIO(content) if isinstance(content, bytes) else content
    if path.endswith(".gz"):
        f = gzip.GzipFile(fileobj=f)
    segment_head(read_exact(f, RECORD_HEAD))
    while True:
        at = f.tell()
        try:
            ts = struct.unpack(">q", read_exact(f, 8))[0]
            table = read_field(f).decode("utf-8", "replace")
            kind, number, text = read_id(f)
            data = read_field(f)
        except EOFError:
            return
        yield at, (table, kind, number, text, ts, data)


def split_stream(stream: io.BufferedIOBase, delimiter: bytes, size: int = 4096) -> Iterator[bytes]:
    """Splits a byte stream before each delimiter, reading ``size`` bytes at a time; see ``strings.split_before``."""
    held, scan = b"", 0
    while chunk := stream.read(size):
        held += chunk
        while (at := held.find(delimiter, scan)) >= 0:
            yield held[:at]
            held, scan = held[at:], len(delimiter)
        scan = max(scan, len(held) - len(delimiter) + 1)
    yield held
