"""SQL counterparts of the core queries, for DuckDB over the same tables."""

from __future__ import annotations

import sys
import unicodedata

from inkloom.operators.packed import DELIMITERS, QUOTES
from inkloom.operators.provenance import DEPENDENCIES, STAGES
from inkloom.operators.publish import BATCH_MARK, CALLOUT, ICON
from inkloom.operators.quality import BRACKETS, COMMON_ENGLISH, NUMBER_WORD, simplified_only
from inkloom.operators.segment import CHAPTER_TITLES, STOP_TITLES

_W = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}"
_SPACE = r"[\s\p{Z}\x{0085}\x{000b}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[{_W}][{_W}''’-]*'))"


def _paragraphs(x: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({x}, '\n{_SPACE}*\n'), lambda p: {_strip('p')}), lambda p: p <> '')"


def _listed(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _heading(x: str) -> str:
    return rf"(lower({x}) IN {_listed(CHAPTER_TITLES)} OR regexp_matches({x}, '^(?:(?i:chapter|part|book)\s+(?i:\d+|[ivxlcdm]+|[a-z][a-z -]{{0,30}})|\d{{1,3}}|[IVXLCDM]{{1,10}})$'))"


def _stop(x: str) -> str:
    return rf"(lower({x}) IN {_listed(STOP_TITLES)} OR regexp_matches({x}, '(?i)^about\s+the\s*authors?$'))"


def _fold(x: str) -> str:
    return f"lower(replace({x}, '’', ''''))"


def _compatible() -> str:
    """Rows (c, k) of the characters that NFKC, but not NFC, replaces, worked out from the character database."""
    found = []
    for code in range(0x80, sys.maxunicode + 1):
        if unicodedata.decomposition(chr(code)) and unicodedata.normalize("NFKC", chr(code)) != unicodedata.normalize("NFC", chr(code)):
            found.append(f"({code}, '" + unicodedata.normalize("NFKD", chr(code)).replace("'", "''") + "')")
    return "SELECT chr(code) AS c, k FROM (VALUES " + ", ".join(found) + ") v(code, k)"


# NFKC is NFC once every character has its compatible form; only texts with such a character are taken apart.
_COMPATIBLE = rf"""compatible AS ({_compatible()}),
    apart AS (SELECT page_key, i, c FROM (SELECT page_key, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS c FROM (SELECT page_key, string_split(text, '') AS l FROM pages WHERE regexp_matches(text, '[^\x00-\x7f]')))),
    level AS (SELECT page_key, string_agg(coalesce(k, c), '' ORDER BY i) AS t FROM apart LEFT JOIN compatible USING (c) GROUP BY page_key),
    nfkc AS (SELECT p.page_key, p.book_id, p.page, p.loaded_at, p.text AS raw, regexp_replace(replace(nfc_normalize(coalesce(t, text)), chr(0), ''), '\r\n?', chr(10), 'g') AS text FROM pages p LEFT JOIN level USING (page_key))"""


def _unbroken(x: str) -> str:
    return rf"regexp_replace({x}, '([{_W}])-\n([{_W}])', '\1\2', 'g')"


_JOINED = _unbroken(_unbroken("text"))  # twice, as two breaks may share a letter
_NORMAL = rf"""{_COMPATIBLE},
    normal AS (SELECT *, array_to_string(list_filter(list_transform(string_split_regex({_JOINED}, '\n{_SPACE}*\n'), lambda b:
        array_to_string(list_filter(list_transform(string_split(regexp_replace(b, '[ \t]+', ' ', 'g'), chr(10)), lambda x: {_strip("x")}), lambda x: x <> ''), ' ')), lambda b: b <> ''), chr(10) || chr(10)) AS normalized
    FROM nfkc)"""
_CONTINUES = rf"""{_NORMAL},
    newest AS (SELECT *, {_paragraphs("coalesce(normalized, '')")} AS l FROM normal QUALIFY row_number() OVER (PARTITION BY book_id, page ORDER BY loaded_at DESC NULLS LAST, page_key DESC NULLS LAST) = 1),
    beside AS (SELECT *, row_number() OVER w AS n, lag(raw) OVER w AS before, lag(CASE WHEN len(l) > 0 THEN l[-1] END) OVER w AS last_block FROM newest WINDOW w AS (PARTITION BY book_id ORDER BY page NULLS FIRST)),
    flagged AS (SELECT *, n > 1 AND NOT coalesce(regexp_matches(before, '\n[ \t]*\n[ \t]*\n?$'), false) AND NOT coalesce({_heading("l[1]")}, false) AND NOT coalesce({_heading("last_block")}, false) AS continues FROM beside)"""
_FOLDED = """list_reduce(list_prepend({first}, {units}), lambda s, x: {step})"""


def _units(l: str, most: str) -> str:  # noqa: E741
    """Units of at most ``most`` words of a list of sentences and their word counts (s, w)."""
    tokens = f"list_filter(string_split_regex(x.s, '{_SPACE}+'), lambda t: t <> '')"
    windows = f"list_transform(range(0, len({tokens}), {most}), lambda i: array_to_string(list_slice({tokens}, i + 1, i + {most}), ' '))"
    full, long = f"(s.now <> '' AND s.n + x.w > {most})", f"(x.w > {most})"
    first = "{'s': '', 'w': 0::BIGINT, 'done': []::VARCHAR[], 'now': '', 'n': 0::BIGINT}"
    units = f"list_transform({l}, lambda s: {{'s': s, 'w': {_words('s')}, 'done': []::VARCHAR[], 'now': '', 'n': 0::BIGINT}})"
    done = f"CASE WHEN {full} THEN list_append(s.done, s.now) ELSE s.done END"
    now, n = f"CASE WHEN {full} THEN '' ELSE s.now END", f"CASE WHEN {full} THEN 0 ELSE s.n END"
    step = f"""{{'s': x.s, 'w': x.w, 'done': CASE WHEN {long} THEN list_concat({done}, {windows}) ELSE {done} END,
        'now': CASE WHEN {long} THEN {now} WHEN ({now}) = '' THEN x.s ELSE ({now}) || ' ' || x.s END, 'n': CASE WHEN {long} THEN {n} ELSE ({n}) + x.w END}}"""
    return _FOLDED.format(first=first, units=units, step=step)


def _sentences(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.!?]){_SPACE}+([\"''“‘A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))"


_CHUNK_STEP = """{'w': x.w, 'h': x.h, 't': x.t, 'm': x.m, 'c': s.c + CASE WHEN s.c = 0 OR x.h OR s.n + x.w > x.m OR s.n >= x.t THEN 1 ELSE 0 END,
    'n': x.w + CASE WHEN s.c = 0 OR x.h OR s.n + x.w > x.m OR s.n >= x.t THEN 0 ELSE s.n END,
    'out': list_append(s.out, s.c + CASE WHEN s.c = 0 OR x.h OR s.n + x.w > x.m OR s.n >= x.t THEN 1 ELSE 0 END)}"""
_CHUNK_FOLD = _FOLDED.format(first="{'w': 0::BIGINT, 'h': false, 't': 0::BIGINT, 'm': 0::BIGINT, 'c': 0::BIGINT, 'n': 0::BIGINT, 'out': []::BIGINT[]}", units="l", step=_CHUNK_STEP)
_UNIT = "{{'w': {w}, 'h': {h}, 't': {t}::BIGINT, 'm': {m}::BIGINT, 'c': 0::BIGINT, 'n': 0::BIGINT, 'out': []::BIGINT[]}}"
_BOOK_CHUNKS = rf"""
    WITH {_CONTINUES},
    blocks AS (SELECT book_id, page, continues, unnest(range(1, len(l) + 1)) AS b, unnest(l) AS t FROM flagged WHERE book_id IS NOT NULL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page NULLS FIRST, b) AS n FROM blocks),
    opened AS (SELECT *, NOT (continues AND b = 1) OR n = 1 AS opens FROM placed),
    past AS (SELECT *, sum(CASE WHEN opens AND {_stop("t")} THEN 1 ELSE 0 END) OVER w AS stopped, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER w AS pos FROM opened WINDOW w AS (PARTITION BY book_id ORDER BY n)),
    near AS (SELECT *, lead(t) OVER (PARTITION BY book_id, pos ORDER BY n) AS after FROM past WHERE stopped = 0),
    paras AS (SELECT book_id, pos, min(page) AS page_start, max(page) AS page_end,
        string_agg(CASE WHEN after IS NULL THEN t WHEN regexp_matches(t, '[{_W}]-$') AND regexp_matches(after, '^[{_W}]') THEN left(t, -1) ELSE t || ' ' END, '' ORDER BY n) AS t FROM near GROUP BY ALL),
    bounded AS (SELECT paras.*, chunk_target_words AS target, chunk_max_words AS most FROM paras JOIN project USING (book_id)),
    short AS (SELECT book_id, pos, 1 AS part, page_start, page_end, target, most, t FROM bounded WHERE {_words("t")} <= most),
    folded AS (SELECT *, {_units(_sentences("t"), "most")} AS f FROM bounded WHERE {_words("t")} > most),
    cut AS (SELECT *, list_filter(CASE WHEN f.now <> '' THEN list_append(f.done, f.now) ELSE f.done END, lambda u: {_strip("u")} <> '') AS u FROM folded),
    units AS (SELECT * FROM short UNION ALL SELECT book_id, pos, unnest(range(1, len(u) + 1)), page_start, page_end, target, most, unnest(u) FROM cut),
    books AS (SELECT book_id, list({_UNIT.format(w=_words("t"), h=_heading("t"), t="target", m="most")} ORDER BY pos, part) AS l, list({{'p': page_start, 'q': page_end, 't': t}} ORDER BY pos, part) AS texts FROM units GROUP BY book_id),
    filled AS (SELECT book_id, texts, {_CHUNK_FOLD} AS r FROM books),
    single AS (SELECT book_id, unnest(r.out) AS c, unnest(texts) AS x, unnest(range(1, len(texts) + 1)) AS i FROM filled),
    chunked AS (SELECT book_id, c, arg_min(x.p, i) AS page_start, arg_max(x.q, i) AS page_end, string_agg(x.t, chr(10) || chr(10) ORDER BY i) AS source FROM single GROUP BY ALL)
    SELECT book_id, format('chunk-{{:04d}}', c) AS chunk_id, CAST(c AS INTEGER) AS chunk_index, page_start, page_end, CAST({_words("source")} AS INTEGER) AS source_words, CAST(length(source) AS INTEGER) AS source_chars, sha256(source || chr(0)) AS source_sha256 FROM chunked"""

_LATEST_CHUNKS = "SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY loaded_at DESC NULLS LAST, chunk_key DESC NULLS LAST) = 1"
_LATEST_PAGES = "SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY book_id, page ORDER BY loaded_at DESC NULLS LAST, page_key DESC NULLS LAST) = 1"
_MARKER = "format('<!-- {}; source pages {}-{} -->', chunk_id, page_start, page_end)"
_BOOKS = f"""SELECT book_id, string_agg({_MARKER} || chr(10) || chr(10) || trim(source), chr(10) || chr(10) ORDER BY chunk_index) || chr(10) AS book_text, count(*) AS pieces
    FROM ({_LATEST_CHUNKS}) WHERE source IS NOT NULL GROUP BY book_id"""
_MADE = rf"""SELECT book_id, p, CASE WHEN content = '* * *' THEN 'divider' WHEN regexp_matches(content, '^#{{1,6}}\s+.+$') THEN 'heading_1' ELSE 'paragraph' END AS type,
        CASE WHEN content = '* * *' THEN '' WHEN regexp_matches(content, '^#{{1,6}}\s+.+$') THEN regexp_replace(content, '^#{{1,6}}\s+', '') ELSE content END AS content
    FROM (SELECT book_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS content FROM (SELECT book_id, {_paragraphs("book_text")} AS l FROM ({_BOOKS})))
    WHERE NOT regexp_matches(content, '^<!--\s*chunk-\d{{4}};.*-->$')"""
_OPENING = f"format('{CALLOUT.replace('%s', '{}')}', book_name, coalesce(author, ''))"
_BLOCKS = f"""SELECT m.book_id, 3 + row_number() OVER (PARTITION BY m.book_id ORDER BY p) AS pos, type, content FROM ({_MADE}) m JOIN project USING (book_id)
    UNION ALL SELECT book_id, v.i, v.type, CASE v.i WHEN 1 THEN {_OPENING} ELSE '' END FROM project JOIN (SELECT DISTINCT book_id FROM ({_BOOKS})) USING (book_id), (VALUES (1, 'callout'), (2, 'table_of_contents'), (3, 'divider')) v(i, type)"""


def _runs(x: str) -> str:
    """A text as a list of (content, bold, italic) runs; emphasis stands in the even pieces."""
    cut = rf"string_split(regexp_replace({x}, '(\*\*.+?\*\*|\*[^*\n]+?\*)', chr(1) || '\1' || chr(1), 'g'), chr(1))"
    bold = "(i % 2 = 0 AND t LIKE '**%')"
    bare = f"CASE WHEN i % 2 = 1 THEN t WHEN {bold} THEN substring(t, 3, length(t) - 4) ELSE substring(t, 2, length(t) - 2) END"
    runs = f"flatten(list_transform({cut}, lambda t, i: list_transform(range(0, length({bare}), 2000), lambda k: {{'content': substring({bare}, k + 1, 2000), 'bold': {bold}, 'italic': i % 2 = 0 AND NOT {bold}}})))"
    return f"CASE WHEN len({runs}) = 0 THEN [{{'content': '', 'bold': false, 'italic': false}}] ELSE {runs} END"


_RICH = f"""'[' || array_to_string(list_transform({_runs("content")}, lambda r: '{{"bold":' || r.bold || ',"code":false,"content":' || CAST(to_json(r.content) AS VARCHAR) || ',"italic":' || r.italic || ',"strikethrough":false,"underline":false}}'), ',') || ']'"""
_CANONICAL = f"""CASE WHEN type = 'callout' THEN '{{"icon":{{"emoji":"{ICON}","type":"emoji"}},' WHEN type IN ('paragraph', 'heading_1') THEN '{{' ELSE '{{"type":"' || type || '"}}' END
    || CASE WHEN type IN ('callout', 'paragraph', 'heading_1') THEN '"rich_text":' || {_RICH} || ',"type":"' || type || '"}}' ELSE '' END"""
_BATCHES = f"""SELECT book_id, CAST((pos - 1) // 100 + 1 AS BIGINT) AS batch_no, count(*) AS block_count, sha256('[' || string_agg({_CANONICAL}, ',' ORDER BY pos) || ']') AS batch_hash
    FROM ({_BLOCKS}) GROUP BY 1, 2"""
_APPROVED = f"SELECT * FROM glossary WHERE lower({_strip('status')}) = 'approved'"
_STATE = """CASE WHEN {t} IS NULL THEN 'no_text' WHEN {h} IS NULL THEN 'unrecorded' WHEN {h} IN (sha256({t}), sha256({t} || chr(0))) THEN 'same' ELSE 'changed' END"""
_CHUNK_STATE, _PAGE_STATE = _STATE.format(t="source", h="source_sha256"), _STATE.format(t="text", h="sha256")
_CONTIGUITY = """SELECT chunk_key, chunk_id, expected FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chunk_index, chunk_id, chunk_key) AS expected FROM {})
    WHERE chunk_index <> expected OR chunk_id <> format('chunk-{{:04d}}', expected)"""
_CLEAN = r"regexp_replace(regexp_replace(text, '(?m)^\s*\*\s+\*\s+\*\s*$', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
_COMMON = "[" + ", ".join(f"'{w}'" for w in COMMON_ENGLISH) + "]"


def _english(x: str) -> str:
    return rf"""list_filter(regexp_extract_all({x}, '[A-Za-z][A-Za-z''’-]*(?:[ \t]+[A-Za-z][A-Za-z''’-]*){{4,}}'), lambda r: len(list_filter(regexp_extract_all(lower(r), '[a-z]+'), lambda w: list_contains({_COMMON}, w))) >= 2)"""


def _placeholder(x: str) -> str:
    return rf"regexp_matches({x}, '(?i)(?:\b(?:TODO|TBD|FIXME|LOREM\s+IPSUM|TRANSLATION)\b|\?\?\?|\[\[.+?\]\]|\{{\{{.+?\}}\}}|<placeholder>)')"


def _bracket_fold(x: str) -> str:
    """What is left of the marks of a text: '!' and a mark that nothing opened, or those that nothing closed."""
    opens = "CASE x " + " ".join(f"WHEN '{b}' THEN '{a}'" for a, b in BRACKETS.items()) + " END"
    marks = rf"string_split(regexp_replace({x}, '[^「」『』（）【】《》〈〉〔〕［］｛｝()\[\]{{}}]', '', 'g'), '')"
    step = f"CASE WHEN s LIKE '!%' THEN s WHEN x = '' THEN s WHEN {opens} IS NULL THEN s || x WHEN right(s, 1) = {opens} THEN left(s, length(s) - 1) ELSE '!' || x END"
    return f"list_reduce(list_prepend('', {marks}), lambda s, x: {step})"


def _count(x: str, c: str) -> str:
    return f"(length({x}) - length(replace({x}, '{c}', '')))"


def _bracket_error(x: str) -> str:
    uneven = " ".join(f"WHEN {_count(x, a)} <> {_count(x, b)} THEN 'uneven {a}{b}'" for a, b in ("“”", "‘’"))
    return f"CASE WHEN left({_bracket_fold(x)}, 1) = '!' THEN 'unexpected ' || substring({_bracket_fold(x)}, 2, 1) WHEN {_bracket_fold(x)} <> '' THEN 'unclosed ' || right({_bracket_fold(x)}, 10) {uneven} END"


def _emphasis(x: str) -> str:
    clean = rf"replace(regexp_replace(regexp_replace({x}, '(?m)^\s*\*\s+\*\s+\*\s*$', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '\*', '')"
    bold = rf"len(regexp_extract_all({clean}, '\*\*'))"
    italic = rf"len(regexp_extract_all(regexp_replace({clean}, '\*\*', '', 'g'), '\*'))"
    return f"CASE WHEN {bold} % 2 = 1 THEN 'odd bold marks' WHEN {italic} % 2 = 1 THEN 'odd italic marks' END"


_EMPHASISED = "SELECT doc_id, regexp_replace(translate(text, '“”', '**'), '[‘’]', '**', 'g') AS text FROM documents WHERE text IS NOT NULL"
_SIMPLIFIED = f"regexp_matches({{}}, '[{simplified_only()}]')"
_TEXT_RULES = {
    "placeholder": _placeholder,
    "english_residue": lambda x: f"len({_english(x)}) > 0",
    "unbalanced_quotes_or_brackets": lambda x: f"({_bracket_error(x)}) IS NOT NULL",
    "unbalanced_emphasis": lambda x: f"({_emphasis(x)}) IS NOT NULL",
}
_SOURCE_HEADING = rf"(?i)^(?:Prologue|Epilogue|Introduction|Afterword|{NUMBER_WORD}|(?:Chapter|Part|Book)\s+(?:\d+|[IVXLCDM]+|{NUMBER_WORD}))$"
_OWN, _OTHER = f"list_filter(sp, lambda p: regexp_matches(p, '{_SOURCE_HEADING}'))", r"list_filter(tp, lambda p: regexp_matches(p, '^#{1,6}\s+\S.*$'))"
_GATE_RULES = {
    "build_source_hash_mismatch": "NOT coalesce(source_sha256 IN (sha256(source), sha256(source || chr(0))), false)",
    "translation_missing": "text IS NULL",
    "translation_meta_missing": "text IS NOT NULL AND doc_id % 5 = 0",
    "translation_meta_invalid": "text IS NOT NULL AND doc_id % 5 <> 0 AND doc_id % 7 = 0",
    "meta_translation_hash_mismatch": "text IS NOT NULL AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 2 = 1",
    "paragraph_count_mismatch": "text IS NOT NULL AND source IS NOT NULL AND len(sp) <> len(tp)",
    "chapter_heading_count_mismatch": f"text IS NOT NULL AND len({_OWN}) <> len({_OTHER})",
    "source_heading_position": f"text IS NOT NULL AND len({_OWN}) > 0 AND sp[1] <> {_OWN}[1]",
    "target_heading_position": f"text IS NOT NULL AND len({_OTHER}) > 0 AND tp[1] <> {_OTHER}[1]",
    **{code: f"text IS NOT NULL AND {rule('text')}" for code, rule in _TEXT_RULES.items()},
}
_GATE = f"""
    WITH c AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chunk_index NULLS FIRST) AS n FROM ({_LATEST_CHUNKS}) WHERE book_id IS NOT NULL),
    d AS (SELECT book_id, doc_id, text, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) AS n FROM documents WHERE book_id IS NOT NULL AND text IS NOT NULL),
    j AS (SELECT c.book_id, c.chunk_id, c.source, c.source_sha256, d.doc_id, d.text, concat_ws(':', c.book_id, c.chunk_id) AS key, {_paragraphs("source")} AS sp, {_paragraphs("text")} AS tp FROM c LEFT JOIN d USING (book_id, n)),
    r AS (SELECT key, unnest(list_filter([{", ".join(f"CASE WHEN {rule} THEN '{code}' END" for code, rule in _GATE_RULES.items())}], lambda x: x IS NOT NULL)) AS code FROM j),
    t AS (SELECT DISTINCT book_id, {_strip("source_term")} AS source_term, target_term FROM ({_APPROVED}) WHERE {_strip("source_term")} <> '' AND target_term <> '')
    SELECT code, key FROM r UNION SELECT 'approved_term_missing', key FROM j JOIN t USING (book_id) WHERE text IS NOT NULL AND NOT contains(text, target_term)
        AND contains(lower(source), lower(source_term)) AND regexp_matches(lower(source), '(^|[^A-Za-z0-9])' || regexp_escape(lower(source_term)) || '([^A-Za-z0-9]|$)')"""
_EDGES = """
    WITH c AS (SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY chunk_index NULLS FIRST) AS VARCHAR) AS i, row_number() OVER (PARTITION BY book_id ORDER BY chunk_index NULLS FIRST) AS n FROM ({})),
    b AS (SELECT DISTINCT book_id FROM c)
    {}"""


def _line(kind: str, columns: str) -> str:
    """Registry rows as JSON lines with sorted names."""
    return " || ', ' || ".join(f"""'"{c}": ' || CAST(to_json(coalesce({c}, '')) AS VARCHAR)""" for c in sorted(columns.split()))


_REGISTRY = f"""
    SELECT book_id, count(*) AS entries, sha256(string_agg(line, chr(10) ORDER BY k, entry_id)) AS snapshot FROM (
        SELECT book_id, 1 AS k, entry_id, '{{' || {_line("glossary", "source_term target_term category status first_chunk notes")} || '}}' AS line FROM ({_APPROVED})
        UNION ALL SELECT book_id, 2, entry_id, '{{' || {_line("characters", "source_name target_name aliases pronouns_or_gender role status notes")} || '}}' FROM characters WHERE lower({_strip('status')}) = 'approved') GROUP BY book_id"""
_SCANS = f"SELECT *, {_fold(_strip('source_term'))} AS term_key FROM term_scans"


def _counted(value: str) -> str:
    """Values of a merged term with their counts, most frequent and then earliest first."""
    return f"""SELECT book_id, term_key, string_agg(v || '=' || n, '|' ORDER BY n DESC, seen, v) AS listed, arg_min(v, (-n, seen, v)) AS top
        FROM (SELECT book_id, term_key, {value} AS v, count(*) AS n, min((coalesce(scanned_at, TIMESTAMP '0001-01-01'), scan_id)) AS seen FROM scans WHERE {value} <> '' GROUP BY ALL) GROUP BY ALL"""



# A value: in quotation marks that close before a delimiter or the end, doubled or lone marks being part of it, or whatever stands before a delimiter.
_DELIMITER = DELIMITERS.replace("\n", r"\n").replace("\t", r"\t").replace("\r", r"\r")
_BLANK = r"[ \p{Z}\x{0085}\x{000b}\x{000c}]"
_VALUE_END = rf"{_BLANK}*(?:[{_DELIMITER}]|$)"


def _quoted(a: str, b: str) -> str:
    doubled = f"{a}{a}|" if a == b else ""
    return (rf"{a}(?:{doubled}[^{b}]|{b}{_BLANK}*[^{b if a == b else ''}{_DELIMITER}\p{{Z}}])*?{b}{_VALUE_END}").replace("'", "''")


def _unquoted(match: str) -> str:
    """The bare value of what was matched."""
    body = _strip(f"regexp_replace({match}, '[{_DELIMITER}]$', '')")
    out = "CASE"
    for a, b in QUOTES.items():
        sa, sb = a.replace("'", "''"), b.replace("'", "''")
        rest = f"substring({body}, 2, length({body}) - 2)"
        rest = f"replace({rest}, '{sa}{sa}', '{sa}')" if a == b else rest
        out += f" WHEN length({body}) >= 2 AND left({body}, 1) = '{sa}' AND right({body}, 1) = '{sb}' AND regexp_matches({match}, '(?s)^{_BLANK}*(?:{_quoted(a, b)})$') THEN {rest}"
    return _strip(f"{out} ELSE {body} END")


_PACKED = rf"""
    WITH c AS (SELECT entry_id, aliases, {_strip("aliases")} AS t FROM characters WHERE {_strip("aliases")} <> ''),
    l AS (SELECT entry_id, CASE WHEN t LIKE '[%]' AND json_valid(t) THEN list_transform(CAST(json_extract_string(t, '$[*]') AS VARCHAR[]), lambda x: {_strip("x")})
        ELSE list_transform(regexp_extract_all(aliases, '(?s){_BLANK}*(?:{"|".join(_quoted(a, b) for a, b in QUOTES.items())}|[^{_DELIMITER}]*(?:[{_DELIMITER}]|$))'), lambda m: {_unquoted("m")}) END AS v FROM c),
    f AS (SELECT entry_id, list_filter(v, lambda x: x <> '') AS v FROM l)
    SELECT entry_id, CAST(unnest(range(1, len(v) + 1)) AS INTEGER) AS pos, unnest(v) AS alias FROM f"""

SQL: dict[str, str] = {
    "p6_found": _PACKED,
    "word_stats": f"SELECT chunk_key, {_words('source')} AS words, length(source) AS chars FROM chunks",
    "source_inspection": """
        SELECT book_id, count(*) AS pages, CAST(sum(c) AS BIGINT) AS characters, list_sort(list(c))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_characters,
            count(*) FILTER (c < 80) AS low_pages, count(*) FILTER (c < 80) / count(*) > 0.5 AS likely_scanned
        FROM (SELECT book_id, coalesce(length(text), 0) AS c FROM pages) GROUP BY book_id""",
    "normalized_pages": f"WITH {_NORMAL} SELECT page_key, normalized FROM normal",
    "book_chunks": _BOOK_CHUNKS,
    "sentence_units": f"""
        WITH folded AS (SELECT doc_id, {_units(_sentences("text"), "60")} AS f FROM documents WHERE {_words("text")} > 60),
        cut AS (SELECT doc_id, [text] AS u FROM documents WHERE {_words("text")} <= 60
            UNION ALL SELECT doc_id, list_filter(CASE WHEN f.now <> '' THEN list_append(f.done, f.now) ELSE f.done END, lambda u: {_strip("u")} <> '') FROM folded)
        SELECT doc_id, unnest(range(1, len(u) + 1)) AS pos, unnest(u) AS unit FROM cut""",
    "document_paragraphs": f"SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS paragraph FROM (SELECT doc_id, {_paragraphs('text')} AS l FROM documents)",
    "greedy_chunks": f"""
        WITH p AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS t FROM (SELECT doc_id, {_paragraphs("text")} AS l FROM documents)),
        u AS (SELECT doc_id, list({_UNIT.format(w=_words("t"), h=_heading("t"), t="180", m="230")} ORDER BY pos) AS l, list({_words("t")} ORDER BY pos) AS ws FROM p GROUP BY doc_id),
        f AS (SELECT doc_id, ws, {_CHUNK_FOLD} AS r FROM u)
        SELECT doc_id, c AS chunk_index, count(*) AS paragraphs, CAST(sum(w) AS BIGINT) AS words FROM (SELECT doc_id, unnest(r.out) AS c, unnest(ws) AS w FROM f) GROUP BY ALL""",
    "page_continuation": f"WITH {_CONTINUES} SELECT page_key, book_id, page, continues FROM flagged",
    "heading_flags": f"""
        SELECT page_key, pos, h AS heading FROM (SELECT page_key, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS h FROM (SELECT page_key, {_paragraphs("text")} AS l FROM pages))
        WHERE {_heading("h")} OR {_stop("h")}""",
    "emphasis_parity": f"SELECT doc_id, error FROM (SELECT doc_id, {_emphasis('text')} AS error FROM ({_EMPHASISED})) WHERE error IS NOT NULL",
    "bracket_balance": f"SELECT doc_id, error FROM (SELECT doc_id, {_bracket_error('text')} AS error FROM documents WHERE text IS NOT NULL) WHERE error IS NOT NULL",
    "english_residue": f"SELECT doc_id, n AS runs FROM (SELECT doc_id, coalesce(len({_english('text')}), 0) AS n FROM documents) WHERE n > 0",
    "script_ratio": f"SELECT doc_id, len(regexp_extract_all(text, '[㐀-鿿]')) AS han, round_even(len(regexp_extract_all(text, '[㐀-鿿]')) / greatest(1, {_words('text')}), 3) AS ratio FROM documents",
    "term_hits": rf"""
        WITH t AS (SELECT DISTINCT book_id, {_strip("source_term")} AS source_term FROM ({_APPROVED}) WHERE {_strip("source_term")} <> '')
        SELECT chunk_key, source_term FROM chunks JOIN t USING (book_id)
        WHERE contains(lower(source), lower(source_term)) AND regexp_matches(lower(source), '(^|[^A-Za-z0-9])' || regexp_escape(lower(source_term)) || '([^A-Za-z0-9]|$)')""",
    "alias_hits": f"""
        WITH a AS (SELECT book_id, entry_id, {_strip("source_name")} AS name, string_split(aliases, '|') AS l FROM characters WHERE lower({_strip("status")}) = 'approved' AND {_strip("source_name")} <> ''),
        n AS (SELECT book_id, entry_id, name FROM a UNION SELECT book_id, entry_id, {_strip("x")} FROM (SELECT book_id, entry_id, unnest(l) AS x FROM a) WHERE {_strip("x")} <> '')
        SELECT DISTINCT chunk_key, entry_id FROM chunks JOIN n USING (book_id) WHERE contains(lower(source), lower(name))""",
    "proposal_conflicts": f"""
        WITH g AS (SELECT DISTINCT book_id, {_fold(_strip("source_term"))} AS k, target_term AS wanted FROM ({_APPROVED}) WHERE {_strip("source_term")} <> '' AND target_term <> '')
        SELECT scan_id, wanted FROM term_scans s JOIN g ON s.book_id = g.book_id AND {_fold(_strip("s.source_term"))} = g.k WHERE proposed_target <> '' AND NOT contains(proposed_target, wanted)""",
    "glossary_conflicts": f"""
        SELECT book_id, {_fold(_strip("source_term"))} AS term, count(DISTINCT {_strip("target_term")}) AS n_targets, array_to_string(list_sort(list_distinct(list({_strip("target_term")}))), '|') AS targets
        FROM glossary WHERE {_strip("source_term")} <> '' AND {_strip("target_term")} <> '' GROUP BY 1, 2 HAVING n_targets > 1""",
    "glossary_conflicts_exact": f"""
        SELECT book_id, source_term AS term, count(DISTINCT {_strip("target_term")}) AS n_targets
        FROM glossary WHERE {_strip("source_term")} <> '' AND {_strip("target_term")} <> '' GROUP BY 1, 2 HAVING n_targets > 1""",
    "term_candidates": f"""
        WITH scans AS (SELECT book_id, {_fold(_strip("source_term"))} AS term_key, {_strip("source_term")} AS form, {_strip("proposed_target")} AS target, {_strip("notes")} AS note, chunk_id, scanned_at, scan_id FROM term_scans WHERE {_strip("source_term")} <> ''),
        b AS (SELECT book_id, term_key, count(*) AS mentions, min(chunk_id) AS first_chunk FROM scans GROUP BY ALL),
        f AS ({_counted("form")}), t AS ({_counted("target")}),
        n AS (SELECT book_id, term_key, string_agg(note, '|' ORDER BY seen) AS notes FROM (SELECT book_id, term_key, note, min((coalesce(scanned_at, TIMESTAMP '0001-01-01'), scan_id)) AS seen FROM scans WHERE note <> '' GROUP BY book_id, term_key, note
            QUALIFY row_number() OVER (PARTITION BY book_id, term_key ORDER BY seen) <= 3) GROUP BY book_id, term_key)
        SELECT b.book_id, b.term_key, f.top AS source_term, mentions, first_chunk, f.listed AS forms, coalesce(t.listed, '') AS targets, coalesce(notes, '') AS notes
        FROM b LEFT JOIN f USING (book_id, term_key) LEFT JOIN t USING (book_id, term_key) LEFT JOIN n USING (book_id, term_key)""",
    "new_terms": f"""
        SELECT scan_id, book_id, term_key FROM ({_SCANS}) s
        WHERE term_key <> '' AND NOT EXISTS (SELECT 1 FROM glossary g WHERE g.book_id = s.book_id AND {_fold(_strip("g.source_term"))} = s.term_key)
        QUALIFY row_number() OVER (PARTITION BY book_id, term_key ORDER BY scanned_at NULLS FIRST, scan_id) = 1""",
    "neighbor_context": f"""
        SELECT chunk_key, coalesce(right(lag(coalesce(source, '')) OVER w, 120), '(Beginning of book.)') AS before_text, coalesce(left(lead(coalesce(source, '')) OVER w, 90), '(End of book.)') AS after_text
        FROM ({_LATEST_CHUNKS}) WINDOW w AS (PARTITION BY book_id ORDER BY chunk_index)""",
    "transitions": f"""
        SELECT chunk_key, previous_end, opening FROM (SELECT chunk_key, right(lag(source) OVER w, 600) AS previous_end, left(source, 900) AS opening, row_number() OVER w AS n, {_paragraphs("source")} AS l
            FROM ({_LATEST_CHUNKS}) WINDOW w AS (PARTITION BY book_id ORDER BY chunk_index)) WHERE n = 1 OR {_heading("l[1]")}""",
    "assemble": f"SELECT book_id, pieces, length(book_text) AS chars, sha256(book_text) AS sha256 FROM ({_BOOKS})",
    "marker_roundtrip": f"""
        SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY chunk_index) AS pos, chunk_id, page_start, page_end FROM ({_LATEST_CHUNKS}) WHERE source IS NOT NULL""",
    "contiguity": f"SELECT chunk_key, expected FROM ({_CONTIGUITY.format('chunks')})",
    "latest_pages": f"SELECT page_key, book_id, page FROM ({_LATEST_PAGES})",
    "chosen_target": f"""
        SELECT book_id, term_key, target_term, entry_id FROM (SELECT book_id, {_fold(_strip("source_term"))} AS term_key, target_term, entry_id,
            CASE lower({_strip("status")}) WHEN 'approved' THEN 1 WHEN 'provisional' THEN 2 ELSE 3 END AS rank FROM glossary WHERE target_term <> '')
        QUALIFY row_number() OVER (PARTITION BY book_id, term_key ORDER BY rank, entry_id) = 1""",
    "hash_drift": f"SELECT page_key, {_PAGE_STATE} AS state FROM pages WHERE state <> 'same'",
    "chunk_drift": f"SELECT chunk_key, {_CHUNK_STATE} AS state FROM chunks WHERE state <> 'same'",
    "content_hashes": "SELECT sha256(text) AS plain, sha256(text || chr(0)) AS parts, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1, 2 HAVING copies > 1",
    "cache_misses": f"""
        WITH l AS ({_LATEST_CHUNKS})
        SELECT chunk_key FROM l WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.book_id = l.book_id AND c.chunk_id = l.chunk_id AND c.source_sha256 = l.source_sha256 AND c.chunk_key NOT IN (SELECT chunk_key FROM l))""",
    "status_counts": f"""
        SELECT status, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lower({_strip("status")}) AS status, count(*) AS n FROM glossary GROUP BY 1
            UNION ALL SELECT s, 0 FROM (VALUES ('approved'), ('provisional'), ('rejected'), ('stale')) v(s)) GROUP BY status""",
    "usage_totals": """
        SELECT name, round(sum(v), 3) AS total, count(*) AS n FROM (SELECT k AS name, try_cast(json_extract_string(props, '$."' || k || '"') AS DOUBLE) AS v
            FROM (SELECT props, unnest(json_keys(props)) AS k FROM events)) WHERE v IS NOT NULL GROUP BY name""",
    "claim_order": "SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, ts NULLS FIRST, event_id LIMIT 20",
    "ready_tasks": "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus <> 'F')",
    "downstream_closure": """
        WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS s, 'n' || n_nationkey AS t FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
        d(node) AS (SELECT t FROM e WHERE s = 'r1' UNION SELECT t FROM e JOIN d ON e.s = d.node) SELECT node FROM d""",
    "plan_tasks": _EDGES.format(_LATEST_CHUNKS, """
        SELECT book_id, s || ':' || i AS task_id, s AS stage FROM c, (VALUES ('terms'), ('translate'), ('review'), ('finalize')) v(s)
        UNION ALL SELECT book_id, s, split_part(s, ':', 1) FROM b, (VALUES ('metadata'), ('terms:consolidate'), ('assemble'), ('quality'), ('audit'), ('publish')) v(s)"""),
    "plan_edges": _EDGES.format(_LATEST_CHUNKS, """
        SELECT book_id, 'terms:' || i AS task_id, 'metadata' AS depends_on FROM c UNION ALL SELECT book_id, 'terms:consolidate', 'terms:' || i FROM c
        UNION ALL SELECT book_id, 'translate:' || i, 'terms:consolidate' FROM c UNION ALL SELECT book_id, 'review:' || i, 'translate:' || i FROM c
        UNION ALL SELECT book_id, 'finalize:' || i, 'review:' || i FROM c UNION ALL SELECT book_id, 'assemble', 'finalize:' || i FROM c
        UNION ALL SELECT book_id, 'finalize:' || i, 'finalize:' || (n - 1) FROM c WHERE n > 1
        UNION ALL SELECT book_id, v.t, v.d FROM b, (VALUES ('quality', 'assemble'), ('audit', 'quality'), ('publish', 'audit')) v(t, d)"""),
    "invalidation_plan": f"""
        WITH s AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(STAGES, 1))}) v(i, stage)),
        d AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{x}')" for k, x in DEPENDENCIES.items())}) v(dependency, stage)),
        c AS (SELECT book_id, 'source' AS dependency FROM pages WHERE {_PAGE_STATE} = 'changed' UNION SELECT g.book_id, 'references' FROM glossary g JOIN project p USING (book_id) WHERE updated_at > created_at),
        f AS (SELECT book_id, min(s.i) AS first FROM project LEFT JOIN c USING (book_id) LEFT JOIN d USING (dependency) LEFT JOIN s USING (stage) GROUP BY book_id)
        SELECT book_id, CAST(i AS INTEGER) AS stage_no, stage, coalesce(i >= first, false) AS stale FROM f, s""",
    "input_issues": f"""
        SELECT 'chunks_missing' AS code, CAST(book_id AS VARCHAR) AS key FROM project WHERE book_id NOT IN (SELECT book_id FROM chunks WHERE book_id IS NOT NULL)
        UNION ALL SELECT 'glossary_missing', CAST(book_id AS VARCHAR) FROM project WHERE book_id NOT IN (SELECT book_id FROM glossary WHERE book_id IS NOT NULL)
        UNION ALL SELECT DISTINCT 'chunk_order_invalid', CAST(book_id AS VARCHAR) FROM chunks WHERE chunk_key IN (SELECT chunk_key FROM ({_CONTIGUITY.format("(SELECT * FROM chunks WHERE book_id IS NOT NULL)")}))
        UNION ALL SELECT DISTINCT 'glossary_conflict', CAST(book_id AS VARCHAR) FROM (SELECT book_id FROM ({_APPROVED}) WHERE book_id IS NOT NULL AND {_strip("source_term")} <> '' AND {_strip("target_term")} <> ''
            GROUP BY book_id, {_fold(_strip("source_term"))} HAVING count(DISTINCT {_strip("target_term")}) > 1)""",
    "gate_issues": _GATE,
    "quality_issues": f"""
        SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([{", ".join(f"CASE WHEN {rule('text')} THEN '{code}' END" for code, rule in _TEXT_RULES.items())}, CASE WHEN {_SIMPLIFIED.format("text")} THEN 'simplified_chinese' END], lambda x: x IS NOT NULL)) AS code FROM documents WHERE text IS NOT NULL
            UNION ALL SELECT 'build_source_hash_mismatch' FROM chunks WHERE {_CHUNK_STATE} = 'changed') GROUP BY code""",
    "publication_blocks": f"SELECT book_id, type, count(*) AS blocks, CAST(sum(length(content)) AS BIGINT) AS chars FROM ({_BLOCKS}) GROUP BY 1, 2",
    "inline_tokens": f"""
        SELECT doc_id, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS pos, unnest(l).content AS content, unnest(l).bold AS bold, unnest(l).italic AS italic FROM (SELECT doc_id, {_runs("text")} AS l FROM ({_EMPHASISED}))""",
    "remote_batches": f"""
        SELECT book_id, batch_no, block_count, CASE WHEN last AND book_id % 3 = 0 THEN block_count - 1 ELSE block_count END AS present,
            CASE WHEN last AND book_id % 3 = 0 THEN 'incomplete' ELSE 'verified' END AS state, batch_hash
        FROM (SELECT *, batch_no = max(batch_no) OVER (PARTITION BY book_id) AS last FROM ({_BATCHES}))""",
    "block_batches": _BATCHES,
    "batch_merge": f"SELECT book_id, batch_no, CASE WHEN batch_no % 3 = 0 THEN 'upload' WHEN batch_no = 1 OR batch_no % 2 = 0 THEN 'done' ELSE 'changed' END AS state FROM ({_BATCHES})",
    "run_pieces": """
        SELECT doc_id, i + 1 AS pos, substring(text, i * 2000 + 1, 2000) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 2000) AS BIGINT)))) AS i FROM documents WHERE text IS NOT NULL)""",
    "slugs": "SELECT book_id, coalesce(nullif(trim(regexp_replace(lower(book_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'book') AS name_slug FROM project",
    "registry_dump": _REGISTRY,
    "context_packets": f"""
        WITH c AS (SELECT *, coalesce(right(lag(coalesce(source, '')) OVER w, 1200), '(Beginning of book.)') AS b, coalesce(left(lead(coalesce(source, '')) OVER w, 900), '(End of book.)') AS a
            FROM ({_LATEST_CHUNKS}) WINDOW w AS (PARTITION BY book_id ORDER BY chunk_index NULLS FIRST))
        SELECT chunk_key, sha256(concat_ws(chr(0), coalesce(snapshot, '-'), b, coalesce(source, ''), a)) AS packet_sha256 FROM c LEFT JOIN ({_REGISTRY}) r USING (book_id)""",
}
