"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

from collections import defaultdict

from spoolwright.llm.words import record_text, word_set


def repeats(history: list[dict], batch: list[dict], key=("table_name", "id_kind", "id_int", "id_str")) -> set[tuple[int, int]]:
    accepted = defaultdict(list)
    for r in history:
        accepted[tuple(r[k] for k in key)].append((r["record_seq"], word_set(record_text(r["data"]))))
    out = set()
    for r in sorted(batch, key=lambda r: r["record_seq"]):
        k, w = tuple(r[k] for k in key), word_set(record_text(r["data"]))
        like = [s for s, v in accepted[k] if 10 * len(w & v) >= 7 * len(w | v)]
        if like:
            out.add((min(like), r["record_seq"]))
        else:
            accepted[k].append((r["record_seq"], w))
    return out
