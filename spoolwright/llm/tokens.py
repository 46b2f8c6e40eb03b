"""Tokens of a public byte-level BPE vocabulary.

The vocabulary is a file of ranks (base64 of a token, its rank) and a split pattern; both are parameters. Unset, they
are the 50k byte-level vocabulary among the installed public tokenizers. Each Python worker loads it once.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"


#: The library's own pattern matcher runs out of stack on runs of blanks much longer than this.
LONG_BLANKS = re.compile(r"\s{10000}")


class Tokenizer:
    def __init__(self, ranks_file: str | None, pattern: str | None):
        if ranks_file is None or pattern is None:
            import public_tokenizers as public

            ranks_file, pattern = ranks_file or public.path(VOCABULARY), pattern or public.PATTERN
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(pattern)

        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def encode(self, text: str) -> list[int]:
        if len(text) >= 10_000 and LONG_BLANKS.search(text):  # split here, then encode word by word
            return [n for w in self.words.findall(text) for n in self.encoding._encode_single_piece(w)]
        return self.encoding.encode_ordinary(text)

    def count(self, text: str) -> int:
        return len(self.encode(text))


@lru_cache(maxsize=2)
def tokenizer(ranks_file: str | None = None, pattern: str | None = None) -> Tokenizer:
    return Tokenizer(ranks_file, pattern)


def with_token_count(df: DataFrame, row_id: str, text: str, ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """``row_id`` and ``n_tokens`` of each row's whole text; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks_file, pattern)
        for b in batches:
            n = [t.count(s) if s else 0 for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "n_tokens"])

    kind = dict(df.dtypes)[row_id]
    out = df.select(F.col(row_id).alias("id"), F.col(text)).mapInArrow(run, f"id {kind}, n_tokens bigint")
    return out.withColumnRenamed("id", row_id)


def may_exceed(text: Column, tokens: int) -> Column:
    """False where a text has at most ``tokens`` tokens for certain: every token of a byte-level vocabulary is at
    least one byte."""
    return F.octet_length(text) > tokens
