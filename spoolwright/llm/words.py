"""Words of texts."""

from __future__ import annotations

import re
import sys
import unicodedata

#: A longest run of letters and digits; ``\w`` without the underscore.
WORD = re.compile(r"[^\W_]+")


def record_text(data: bytes | None) -> str:
    """UTF-8, or windows-1251 if the bytes aren't valid UTF-8; null is the empty text."""
    if data is None:
        return ""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1251", "replace")


def word_set(text: str) -> set[str]:
    return {w.lower() for w in WORD.findall(text)}


def _format_characters() -> dict[int, None]:
    return {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"}


_CF: dict[int, None] = {}


def plain_words(text: str | None) -> list[str]:
    """Words in order after NFKC normalisation, removal of format characters (Cf) and lower-casing."""
    if not text:
        return []
    if not text.isascii():
        if not _CF:
            _CF.update(_format_characters())
        text = unicodedata.normalize("NFKC", text).translate(_CF)
    return WORD.findall(text.lower())
