"""SQL for the llm queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

import sys
import unicodedata

from inkloom.llm.lookalikes import PROTOTYPES

_W = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}"
_WORDS = rf"len(regexp_extract_all(c.source, '[{_W}][{_W}''’-]*'))"


def _plain(x: str) -> str:
    return rf"coalesce(regexp_replace(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g'), '')"


_FIELDS = rf"string_split(regexp_replace(record_text, '\s*[|;,\n\t]\s*(\w[\w \-]{{0,60}}?\s*[:=])', chr(4) || '\1', 'g'), chr(4))"
_LISTED = rf"list_transform({_FIELDS}, lambda p: {{'n': {_plain("regexp_extract(p, '^([^:=]*)[:=]', 1)")}, 'v': {_plain("regexp_extract(p, '(?s)^[^:=]*[:=](.*)$', 1)")}}})"
_PARSED = rf"""list_transform(json_keys(record_text), lambda k: {{'n': {_plain("k")}, 'v': {_plain("json_extract_string(record_text, '$." + '"' + "' || k || '" + '"' + "')")}}})"""
_KEYS = f"""
    SELECT 'glossary' AS table_name, entry_id AS id, book_id, {_plain("source_term")} AS key FROM glossary
    UNION ALL SELECT 'term_scans', scan_id, book_id, concat_ws(chr(1), {_plain("chunk_id")}, {_plain("source_term")}, {_plain("proposed_target")}, {_plain("category")}) FROM term_scans
    UNION ALL SELECT 'term_records', record_id, book_id, CASE WHEN trim(record_text) LIKE '{{%'
            THEN array_to_string(list_transform(list_sort(list_filter({_PARSED}, lambda f: f.n <> '' AND f.v <> '')), lambda f: f.n || chr(1) || f.v), chr(2))
            ELSE array_to_string(list_transform(list_sort(list_filter({_LISTED}, lambda f: f.n <> '' AND f.v <> '')), lambda f: f.n || chr(1) || f.v), chr(2)) END FROM term_records"""
_GROUPS = f"SELECT *, min(id) OVER w AS first_id, count(*) OVER w AS copies FROM ({_KEYS}) WHERE book_id IS NOT NULL AND replace(key, chr(1), '') <> '' WINDOW w AS (PARTITION BY table_name, book_id, key)"



def _prototypes() -> str:
    """Rows (c, k) of the characters that the skeleton, composed again, shows as others, worked out from the table of look-alikes."""
    found = []
    for code in range(1, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        own = chr(code)
        seen = unicodedata.normalize("NFD", own).translate(PROTOTYPES)
        if unicodedata.normalize("NFC", seen) != unicodedata.normalize("NFC", own):
            found.append(f"({code}, '" + seen.replace("'", "''") + "')")
    return ", ".join(found)


# The composed skeleton of a text: composed, each character by its prototype, composed again, blanks levelled.
_FORMS = f"""
    WITH t AS (SELECT entry_id, book_id, target_term AS target FROM glossary UNION ALL SELECT entry_id, book_id, target_name FROM characters),
    p AS (SELECT chr(code) AS c, k FROM (VALUES {_prototypes()}) v(code, k)),
    a AS (SELECT entry_id, i, c FROM (SELECT entry_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS c FROM (SELECT entry_id, string_split(nfc_normalize(target), '') AS l FROM t WHERE target <> ''))),
    s AS (SELECT entry_id, trim(regexp_replace(nfc_normalize(string_agg(coalesce(k, c), '' ORDER BY i)), ' +', ' ', 'g')) AS form FROM a LEFT JOIN p USING (c) GROUP BY entry_id),
    f AS (SELECT t.*, CASE WHEN target = '' THEN '' ELSE form END AS consistent FROM t LEFT JOIN s USING (entry_id))"""

SQL: dict[str, str] = {
    "p1_found": f"""{_FORMS}
        SELECT a.entry_id AS first_entry_id, b.entry_id AS second_entry_id FROM f a JOIN f b ON a.book_id = b.book_id AND a.consistent = b.consistent AND a.entry_id < b.entry_id AND a.target <> b.target
        WHERE a.consistent <> ''""",
    "p1_forms": f"""{_FORMS},
        g AS (SELECT book_id, consistent, min(entry_id) AS class_id, count(DISTINCT target) AS forms FROM f WHERE consistent <> '' GROUP BY ALL)
        SELECT f.*, class_id, forms FROM f LEFT JOIN g ON f.book_id = g.book_id AND f.consistent = g.consistent""",
    "p2_found": f"SELECT c.chunk_key FROM chunks c JOIN project p USING (book_id) WHERE {_WORDS} > p.chunk_max_words",
    "p4_found": f"SELECT table_name, first_id, id AS dup_id FROM ({_GROUPS}) WHERE id <> first_id",
    "p4_counts": f"SELECT DISTINCT table_name, first_id, copies FROM ({_GROUPS})",
}
