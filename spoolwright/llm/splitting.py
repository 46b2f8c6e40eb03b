"""Splitting oversized texts at natural boundaries, with overlap.

A text is taken apart into the tokenizer's words, the units between which its tokens never merge, so that a piece cut
between words has exactly the tokens it had in the text. Every cut between words has a strength: before a file of a
diff, a hunk, a paragraph, a line, a sentence, or none of these. A sparse table over the strengths answers, in
constant time, where the strongest cut of a window of lengths lies, the rightmost of equals. The next piece begins
``overlap`` tokens before the cut.

The table is built over stretches of a text, of a bounded number of cuts, so its memory doesn't grow with the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Tokenizer, may_exceed, tokenizer

LIMIT = 4096
OVERLAP = 128
#: A piece is cut no earlier than at this share of the limit.
LEAST_FILL = 0.5
#: Cuts that a table spans.
STRETCH = 65_536

FILE, HUNK, PARAGRAPH, LINE, SENTENCE, WORD, NONE = 6, 5, 4, 3, 2, 1, 0
STRENGTH_NAMES = {FILE: "file", HUNK: "hunk", PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", WORD: "word", NONE: "none"}

#: Begins of lines that begin a file or a hunk of a diff, in the common layouts.
_FILE_LINE = re.compile(r"diff --git |diff -|Index: |=== |From [0-9a-f]{40} |commit [0-9a-f]{7,40}\b")
_HUNK_LINE = re.compile(r"@@ ")
_LINE_END = re.compile(r"\r\n|\n|\r")
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’)\]]*(?=\s)")
_SPACE = re.compile(r"\s")


def boundaries(text: str) -> dict[int, int]:
    """Strengths of the character positions at which a file, hunk, paragraph, line or sentence begins or, for the
    latter, ends."""
    out: dict[int, int] = {}
    for m in _SENTENCE_END.finditer(text):
        out[m.end()] = SENTENCE
    start = 0
    blank = False
    while start <= len(text):
        m = _LINE_END.search(text, start)
        end = m.start() if m else len(text)
        if start:
            if _FILE_LINE.match(text, start):
                s = FILE
            elif _HUNK_LINE.match(text, start):
                s = HUNK
            else:
                s = PARAGRAPH if blank else LINE
            out[start] = s
        blank = not text[start:end].strip()
        if not m:
            break
        start = m.end()
    return out


class StrongestCut:
    """Range maxima over strengths by a sparse table: ``best(lo, hi)`` is the index of the greatest in lo..hi, both
    included, and the rightmost of equals. Each value carries its index, so one maximum settles both."""

    def __init__(self, strengths: np.ndarray, longest: int):
        n = len(strengths)
        level = strengths.astype(np.int64) * n + np.arange(n)
        self.n, self.levels = n, [level]
        width = 1
        while 2 * width <= min(n, longest):
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def best(self, lo: int, hi: int) -> int:
        k = (hi - lo + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[lo], level[hi - (1 << k) + 1]) % self.n)


class Cuts:
    """The places where a text may be cut: character positions, tokens before them and strengths. The text is encoded
    once (``encoded``); where its words end is found by the pattern, and how many tokens lie before by their lengths."""

    def __init__(self, text: str, t: Tokenizer, limit: int, encoded: list[int] | None = None):
        strong = boundaries(text)
        ends = np.fromiter((m.end() for m in t.words.finditer(text)), np.int64)
        if not len(ends) or ends[-1] != len(text):  # nothing the pattern leaves out; kept for other patterns
            ends = np.append(ends, len(text))
        tokens = np.asarray(t.encode(text) if encoded is None else encoded, np.int64)
        before = np.searchsorted(np.cumsum(t.lengths[tokens]), _bytes_before(text, ends), side="right")
        at = np.array(sorted(strong), np.int64)
        word = np.searchsorted(ends, at)  # the word that a boundary lies in, or at whose end
        strengths = np.full(len(ends), WORD)
        # the start of a line lies behind its line end; a word that begins with the blank before it is cut before
        edge = ends[word] == at
        strengths[word[edge]] = [strong[c] for c in at[edge].tolist()]
        # a word that fills much of a piece, or blank lines that are one word: cut inside as well. Its parts are counted
        # apart, which is what they have in pieces of their own
        starts, sizes = np.append(0, ends[:-1]), np.diff(before, prepend=0)
        inside = {w for w in word[~edge].tolist() if text[starts[w] : ends[w]].isspace()} | set(np.flatnonzero(sizes > max(1, limit // 8)).tolist())
        chars, counts, how, done, more = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.array([NONE])], 0, 0
        for w in [*sorted(inside), len(ends)]:
            chars.append(ends[done:w])
            counts.append(before[done:w] + more)
            how.append(strengths[done:w])
            if w < len(ends):
                parts = list(_inside(text[starts[w] : ends[w]], int(starts[w]), strong, t, limit))
                n = np.cumsum([k for _, k in parts])
                chars.append(np.array([c for c, _ in parts]))
                counts.append(before[w] - sizes[w] + more + n)
                how.append(np.array([strong.get(c, NONE) for c, _ in parts]))
                more += int(n[-1] - sizes[w])
            done = w + 1
        self.chars, self.tokens, self.strengths = np.concatenate(chars), np.concatenate(counts), np.concatenate(how)


def _bytes_before(text: str, at: np.ndarray) -> np.ndarray:
    """Bytes of UTF-8 before character positions."""
    if text.isascii():
        return at
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[at]


def _inside(word: str, start: int, strong: dict[int, int], t: Tokenizer, limit: int) -> Iterator[tuple[int, int]]:
    """Ends and token counts of parts of a long word: at boundaries within, else every few characters."""
    step = max(1, limit // 16)
    ends = sorted({*range(step, len(word), step), *(c - start for c in range(start + 1, start + len(word)) if c in strong), len(word)})
    at = 0
    for e in ends:
        yield start + e, t.count(word[at:e])
        at = e


def _back(text: str, t: Tokenizer, cuts: Cuts, first: int, last: int, overlap: int) -> int | None:
    """The nearest cut from which there are at least ``overlap`` tokens to the cut ``last``; none if only ``first`` or
    what lies before it would do. Parts of a word, counted apart, can be more tokens than they are together, so what
    is repeated is counted as it stands, and the cut goes further back by what is missing."""
    end, told = int(cuts.chars[last]), overlap
    while True:
        back = int(np.searchsorted(cuts.tokens, cuts.tokens[last] - told, side="right")) - 1
        if back <= first:
            return None
        missing = overlap - t.count(text[int(cuts.chars[back]) : end])
        if missing <= 0:
            return back
        told = int(cuts.tokens[last] - cuts.tokens[back]) + missing


def pieces(text: str, t: Tokenizer, limit: int = LIMIT, overlap: int = OVERLAP, least_fill: float = LEAST_FILL) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, strength of the cut at the end) of each piece, in characters. A text within the limit is
    one piece. Each later piece begins ``overlap`` tokens before the end of the one before, counted in the text that is
    repeated, or at the nearest place before that where the text may be cut. Only where a single code point takes so
    much of the limit that this leaves no room to go on, less is repeated."""
    if not 0 <= overlap < limit * least_fill:
        raise ValueError("the overlap must be less than the least piece")
    encoded = t.encode(text)
    if len(encoded) <= limit:
        return [(0, len(text), len(encoded), NONE)] if text else []
    cuts = Cuts(text, t, limit, encoded)
    out: list[tuple[int, int, int, int]] = []
    first, done, same = 0, 0, 0  # cuts at which the piece begins and the one before ended, tokens between
    room, least = limit, 1  # least: the first cut at which the piece may end
    table, base = None, 0
    while True:
        begin = cuts.tokens[done] - same
        if cuts.tokens[-1] - begin <= room:
            last = hi = len(cuts.tokens) - 1
        else:
            hi = int(np.searchsorted(cuts.tokens, begin + room, side="right")) - 1
            # progress needs more than the overlap, which the next piece repeats
            lo = int(np.searchsorted(cuts.tokens, begin + max(int(room * least_fill), overlap + 1)))
            lo = min(max(lo, least), max(hi, least))
            hi = max(hi, lo)
            if table is None or hi - base >= table.n or lo < base:
                base = lo
                table = StrongestCut(cuts.strengths[base : base + max(STRETCH, 2 * limit)], limit + 1)
            last = base + table.best(lo - base, hi - base)
        a, b = int(cuts.chars[first]), int(cuts.chars[last])
        n = t.count(text[a:b])
        if n > limit and last > first + 1:
            least = done + 1
            if last > least:  # parts of a long word that count more together
                room -= max(1, n - limit)
            else:  # what is repeated leaves no room
                first += 1
                same = t.count(text[int(cuts.chars[first]) : int(cuts.chars[done])])
            continue
        end = last == len(cuts.tokens) - 1
        back = last if end else _back(text, t, cuts, first, last, overlap)
        if back is None and last < hi and room == limit:  # too short to be repeated from: as long as may be
            least = hi
            continue
        out.append((a, b, n, NONE if end else int(cuts.strengths[last])))
        if end:
            return out
        first, done = min(first + 1, last) if back is None else back, last
        same = t.count(text[int(cuts.chars[first]) : b])
        room, least = limit, done + 1


def split_documents(
    docs: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    least_fill: float = LEAST_FILL,
    ranks_file: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Pieces of the texts with more than ``limit`` tokens: ``row_id``, ``piece`` (from 0), ``start`` and ``stop`` (in
    code points), ``n_tokens``, ``cut`` (what the piece ends before: file, hunk, paragraph, line, sentence, word, none)
    and ``text``. Texts within the limit give no rows; those of at most ``limit`` bytes aren't even tokenized.

    Defined cases: null and empty texts give no rows; a document that occurs twice is split twice; a word of more
    tokens than fit is cut inside, between code points; an empty table gives no rows; texts are read to their end;
    extra columns are not read.
    """
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("n_tokens", pa.int32()), ("cut", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks_file, pattern)
        for b in batches:
            for d, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cut = pieces(s, t, limit, overlap, least_fill)
                if len(cut) > 1:
                    rows = [(d, i, x, y, n, STRENGTH_NAMES[k], s[x:y]) for i, (x, y, n, k) in enumerate(cut)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows = docs.where(may_exceed(F.col(text), limit)).select(F.col(row_id).cast("bigint").alias("id"), text)
    out = rows.mapInArrow(run, "id bigint, piece int, start bigint, stop bigint, n_tokens int, cut string, text string")
    return out.withColumnRenamed("id", row_id)
