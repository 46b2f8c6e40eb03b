"""The same results in DuckDB's SQL, over whole tables."""

from ..functions.text import CP1251_HIGH

ID_KEY = "CASE id_kind WHEN 1 THEN 'i:' || id_int WHEN 2 THEN 's:' || id_str ELSE '' END"

#: Text of ``data``: UTF-8, else byte by byte as windows-1251.
TEXT = (
    "coalesce(try(decode(data)), array_to_string(list_transform(range(0, octet_length(data)), lambda i: "
    "(CASE WHEN ('0x' || substr(hex(data), 2 * i + 1, 2))::INT < 128 THEN chr(('0x' || substr(hex(data), 2 * i + 1, 2))::INT) "
    f"ELSE substr('{CP1251_HIGH}', ('0x' || substr(hex(data), 2 * i + 1, 2))::INT - 127, 1) END)), ''))"
)

FIRST = f"""
WITH texts AS (SELECT record_seq, table_name, id_kind, id_int, id_str, ts, {TEXT} AS body FROM records),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY table_name, id_kind, id_int, id_str, ts, body ORDER BY record_seq) AS nth FROM texts)
"""

COUNTED = """
WITH valid AS (SELECT * FROM source_records WHERE table_name <> '' AND table_name <> chr(0) AND octet_length(log_bytes) > 0),
     published AS (SELECT DISTINCT file_no FROM source_files WHERE suffix(file_path, '.saved') OR suffix(file_path, '.saved.gz')),
     sums AS (SELECT file_no, sum(octet_length(log_bytes)) AS valid_bytes FROM valid GROUP BY file_no),
     counted AS (
         SELECT *, row_number() OVER (PARTITION BY table_name, id_kind, id_int, id_str, ts, log_bytes ORDER BY file_no, pos) AS nth
         FROM valid WHERE file_no IN (SELECT file_no FROM published))
"""

SQL = {
    "p1_found": FIRST
    + f"""SELECT table_name, {ID_KEY} AS id_key FROM ranked WHERE nth = 1 GROUP BY table_name, id_kind, id_int, id_str
HAVING count(*) * 100 >= (SELECT count(*) FROM ranked WHERE nth = 1)""",
    "p1_key_stats": FIRST
    + f"""SELECT table_name, {ID_KEY} AS id_key, count(*) AS messages, min(ts) AS first_ts, max(ts) AS last_ts
FROM ranked WHERE nth = 1 GROUP BY table_name, id_kind, id_int, id_str""",
    "p2_found": FIRST + "SELECT record_seq FROM ranked WHERE nth > 1",
    "p2_first_deliveries": FIRST + "SELECT record_seq, table_name, ts FROM ranked WHERE nth = 1",
    "p3_found": COUNTED + """SELECT DISTINCT table_name, file_no FROM counted JOIN sums USING (file_no)
WHERE nth = 1 AND valid_bytes < 8192""",
    # tables of less than the target size lie in one file each
    "p3_files": COUNTED + "SELECT table_name, count(DISTINCT file_no) AS files_before, 1::BIGINT AS files_after FROM counted WHERE nth = 1 GROUP BY table_name",
    "p3_records": COUNTED + "SELECT table_name, file_no, pos, octet_length(log_bytes)::INT AS n_bytes FROM counted WHERE nth = 1",
}

_ATTRIBUTES = ["tier", "state", "zone", "quota", "owner"]


def _value(a: str) -> str:
    return f"""nullif(lower(trim(CASE WHEN json_valid(t) THEN json_extract_string(t, '$.{a}')
WHEN one_line THEN regexp_extract(t, ';\\s*{a}\\s*=([^;]*)', 1) ELSE regexp_extract(t, '\\n\\s*{a}[ \\t]*:([^\\r\\n]*)', 1) END, ' ' || chr(9) || chr(10) || chr(13))), '')"""


def _given(a: str) -> str:
    return f"""(CASE WHEN json_valid(t) THEN list_contains(json_keys(t), '{a}')
WHEN one_line THEN regexp_matches(t, ';\\s*{a}\\s*=') ELSE regexp_matches(t, '\\n\\s*{a}[ \\t]*:') END)"""


_any = " OR ".join(f"{a} IS NOT NULL" for a in _ATTRIBUTES)
_any_before = " OR ".join(f"b_{a} IS NOT NULL" for a in _ATTRIBUTES)
VERSIONS = f"""
WITH once AS (
    SELECT table_name, {ID_KEY} AS id_key, ts, min(record_seq) AS seq, trim({TEXT}, ' ' || chr(9) || chr(10) || chr(13)) AS t
    FROM entity_records GROUP BY table_name, id_kind, id_int, id_str, ts, data),
told AS (
    SELECT *, regexp_matches(t, '^(?i)(full|patch|drop)[ \\t]*(;[^\\r\\n]*)?$') AS one_line,
        lower(CASE WHEN json_valid(t) THEN json_extract_string(t, '$.op') ELSE regexp_extract(t, '^(?i)(full|patch|drop)([ \\t]*;|[ \\t]*[\\r\\n]|$)', 1) END) AS op
    FROM once),
said AS (SELECT table_name, id_key, ts, seq, op, {", ".join(f"CASE WHEN op <> 'drop' THEN {_value(a)} END AS {a}, (op <> 'patch' OR {_given(a)}) AS set_{a}" for a in _ATTRIBUTES)}
    FROM told WHERE op IN ('full', 'patch', 'drop')),
state AS (
    SELECT table_name, id_key, ts, lead(ts) OVER w AS next_ts,
        {", ".join(f"last_value(CASE WHEN set_{a} THEN {{'v': {a}}} END IGNORE NULLS) OVER w2 AS s_{a}" for a in _ATTRIBUTES)}
    FROM said WINDOW w AS (PARTITION BY table_name, id_key ORDER BY ts, seq),
        w2 AS (PARTITION BY table_name, id_key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
snap AS (SELECT table_name, id_key, ts, {", ".join(f"s_{a}.v AS {a}" for a in _ATTRIBUTES)} FROM state WHERE next_ts IS DISTINCT FROM ts),
seen AS (SELECT *, {", ".join(f"lag({a}) OVER w AS b_{a}" for a in _ATTRIBUTES)} FROM snap WINDOW w AS (PARTITION BY table_name, id_key ORDER BY ts)),
event AS (SELECT *, CASE WHEN ({_any}) AND NOT ({_any_before}) THEN 'inserted' WHEN ({_any_before}) AND NOT ({_any}) THEN 'deleted'
    WHEN {" OR ".join(f"{a} IS DISTINCT FROM b_{a}" for a in _ATTRIBUTES)} THEN 'changed' END AS kind FROM seen),
period AS (SELECT *, ts AS valid_from, coalesce(lead(ts) OVER (PARTITION BY table_name, id_key ORDER BY ts), -1) AS valid_to
    FROM event WHERE kind IS NOT NULL)
"""

SQL |= {
    "p4_found": VERSIONS + "SELECT table_name, id_key, valid_from, valid_to FROM period WHERE kind <> 'deleted'",
    "p4_versions": VERSIONS + f"SELECT table_name, id_key, kind, {', '.join(_ATTRIBUTES)}, valid_from, valid_to FROM period WHERE kind <> 'deleted'",
}

#: The state at six times: of each entity the last snapshot by then, if it has attributes; then as above.
SNAPSHOTS = VERSIONS.split("seen AS")[0] + f"""
times AS (SELECT lo + (hi - lo) * i // 6 AS t FROM (SELECT min(ts) AS lo, max(ts) AS hi FROM entity_records), (SELECT unnest(range(1, 7)) AS i)),
taken AS (SELECT t AS ts, table_name, id_key, {", ".join(f"arg_max({{'v': {a}}}, snap.ts).v AS {a}" for a in _ATTRIBUTES)} FROM times JOIN snap ON snap.ts <= t GROUP BY t, table_name, id_key),
seen AS (SELECT *, {", ".join(f"lag({a}) OVER w AS b_{a}" for a in _ATTRIBUTES)} FROM taken WINDOW w AS (PARTITION BY table_name, id_key ORDER BY ts)),
event AS""" + VERSIONS.split("event AS", 1)[1]

SQL |= {
    "p4_snapshots": SNAPSHOTS + f"SELECT table_name, id_key, kind, {', '.join(_ATTRIBUTES)}, valid_from, valid_to FROM period",
}
