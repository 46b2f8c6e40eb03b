"""Hashes that Spark lacks, over Arrow batches. All rows of a batch are hashed side by side in NumPy, one step for each
four bytes of the longest row and none for each row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .ints import fold_timestamp

#: Constants of MurmurHash3 x86 32.
C1, C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
FINAL1, FINAL2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def murmur3_32(rows: list[bytes], seed: int = 0) -> np.ndarray:
    """Canonical MurmurHash3 x86 32 of each row, signed."""
    n = np.array([len(r) for r in rows], np.int64)
    order = np.argsort(-n, kind="stable")  # so that rows with a block at a position come first
    sizes = n[order]
    padded = (sizes + 3) // 4 * 4
    starts = np.concatenate(([0], np.cumsum(padded)))[:-1] // 4
    words = np.frombuffer(b"".join(rows[i] + b"\0" * (-len(rows[i]) % 4) for i in order), "<u4")
    h = np.full(len(rows), seed, np.uint32)
    full, tail = sizes // 4, sizes % 4
    for b in range(int(full[0]) if len(full) else 0):
        m = int(np.searchsorted(-full, -b, side="left"))  # rows with more than b blocks
        k = _rotl(words[starts[:m] + b] * C1, 15) * C2
        h[:m] = _rotl(h[:m] ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    some = np.flatnonzero(tail)
    if len(some):
        h[some] ^= _rotl(words[starts[some] + full[some]] * C1, 15) * C2
    h ^= sizes.astype(np.uint32)
    h ^= h >> np.uint32(16)
    h *= FINAL1
    h ^= h >> np.uint32(13)
    h *= FINAL2
    h ^= h >> np.uint32(16)
    out = np.empty(len(rows), np.int32)
    out[order] = h.view(np.int32)
    return out


def bytes_hash31(rows: list[bytes]) -> np.ndarray:
    """``h = 31 * h + signed byte`` over each row, from 0, wrapping at 32 bits."""
    n = np.array([len(r) for r in rows], np.int64)
    order = np.argsort(-n, kind="stable")
    sizes = n[order]
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    data = np.frombuffer(b"".join(rows[i] for i in order), np.int8)
    h = np.zeros(len(rows), np.uint32)
    for b in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -b, side="left"))
        h[:m] = h[:m] * np.uint32(31) + data[starts[:m] + b].astype(np.int32).view(np.uint32)
    out = np.empty(len(rows), np.int32)
    out[order] = h.view(np.int32)
    return out


def murmur3(data: Column, seed: int = 0) -> Column:
    """Canonical MurmurHash3 of a binary column (Arrow); null of null. Spark's ``hash`` has another seed and treats the
    last bytes differently."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(murmur3_32([bytes(x) if x is not None else b"" for x in s], seed), dtype="Int32").mask(s.isna())

    return F.pandas_udf(run, "int")(data)


def calc_hash(data: Column, ts: Column) -> Column:
    """A record's hash: its data's xor its folded time. It covers neither table nor identifier."""
    return murmur3(data).bitwiseXOR(fold_timestamp(ts))


def string_id_hash(s: Column) -> Column:
    """Hash of a string identifier over its UTF-8 bytes (Arrow)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(bytes_hash31([bytes(b) if b is not None else b"" for b in x]), dtype="Int32").mask(x.isna())

    return F.pandas_udf(run, "int")(s.cast("binary"))


def record_id_hash(kind: Column, id_int: Column, id_str: Column) -> Column:
    """Hash of an identifier: an int is its own, the empty one's is 0."""
    return F.when(kind == 1, id_int).when(kind == 2, string_id_hash(id_str)).otherwise(F.lit(0))
