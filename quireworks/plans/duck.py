"""DuckDB expressions for the text functions, to check the Spark ones."""

from ..functions import text as T

SPACE = T.SPACE


def strip(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '<[^>]*>|>', ' ', 'g'), '<[^>]*$', '')"
    for name, char in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"')):
        x = f"replace({x}, '&{name};', '{char}')"
    return collapse(x)


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def letters(x: str) -> str:
    return f"length(regexp_replace({x}, '\\P{{L}}', '', 'g'))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda z: z <> '')"


def headings(x: str) -> str:
    """List of structs (level, text)."""
    pattern = "|".join(f"<h{i}>.*?</h{i}>" for i in range(1, 7))
    rows = f"list_transform(regexp_extract_all({x}, '(?s){pattern}'), lambda h: {{'level': CAST(substr(h, 3, 1) AS INT), 'text': substr({strip('h')}, 1, 120)}})"
    return f"list_filter({rows}, lambda r: length(regexp_replace(r.text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 2)"


def keep_xml(x: str) -> str:
    return f"regexp_replace({x}, '{T.NOT_XML}', '', 'g')"


def escape_xml(x: str) -> str:
    x = keep_xml(x)
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("''", "apos")):
        x = f"replace({x}, '{char}', '&{name};')"
    return x


def running(x: str) -> str:
    return f"lower({collapse(f"regexp_replace({x}, '[0-9]', '', 'g')")})"


def math_syntax(x: str) -> str:
    return f"(length({x}) - length(translate({x}, '{T.MATH_SYNTAX}', '')))"


def is_math(font: str, x: str) -> str:
    return f"(regexp_matches(lower({font}), '{'|'.join(T.MATH_FONTS)}') OR regexp_matches({x}, '[{T.MATH_SYMBOLS}]'))"


def relation(x: str) -> str:
    return f"regexp_matches({x}, '[{T.RELATIONS}]')"


def mixed_prose(font: str, x: str) -> str:
    return f"(len(list_filter({words(x)}, lambda z: regexp_matches(z, '\\p{{L}}'))) >= 5 AND NOT {is_math(font, x)})"


def real_words(x: str) -> str:
    return f"len(list_filter({words(x)}, lambda z: {letters('z')} >= 2))"


def trustworthy(tag: str, markup: str) -> str:
    t = strip(f"regexp_replace({markup}, '(?s)^<[^>]*>|</[^>]*>$', '', 'g')")
    return f"({letters(t)} >= 12 AND {real_words(t)} >= CASE WHEN {tag} = 'p' THEN 5 ELSE 2 END AND {math_syntax(t)} = 0 AND NOT contains({t}, '�'))"


def section_heading(x: str, body: str) -> str:
    t = trim(x)
    w = words(t)
    label = f"upper(regexp_replace(list_filter({w}, lambda z: regexp_matches(z, '\\p{{L}}'))[1], '^\\P{{L}}+|\\P{{L}}+$', '', 'g'))"
    plausible = f"length({t}) <= 120 AND {letters(t)} BETWEEN 4 AND 96 AND len({w}) <= 10 AND NOT coalesce({label} IN ({quoted(T.NOT_SECTIONS)}), false)"
    numbered = f"regexp_matches(coalesce({w}[1], ''), '^[0-9.:\\-]*[0-9][0-9.:\\-]*$')"
    capital = f"regexp_matches({t}, '\\p{{Lu}}') AND NOT regexp_matches({t}, '\\p{{Ll}}') AND (len({w}) > 1 OR {letters(t)} >= 7)"
    seen = f"substr({body}, 1, 256)"
    prose = f"{letters(seen)} >= 24 AND len(list_filter(regexp_split_to_array({seen}, '\\P{{L}}+'), lambda z: z <> '')) >= 5"
    known = f"upper(regexp_replace({t}, '[.:;,]+$', '')) IN ({quoted(T.KNOWN_SECTIONS)})"
    return f"({plausible} AND (({numbered}) OR ({capital}) OR ({known} AND {prose})))"


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def overlap(s: tuple[str, str, str, str], r: tuple[str, str, str, str]) -> str:
    sx, sy, sw, sh = s
    rx, ry, rw, rh = r
    w = f"(least({sx} + {sw}, {rx} + {rw}) - greatest({sx}, {rx}))"
    h = f"(least({sy} + {sh}, {ry} + {rh}) - greatest({sy}, {ry}))"
    return f"CASE WHEN {w} > 0 AND {h} > 0 AND {sw} > 0 AND {sh} > 0 THEN least(CAST({w} * {h} / ({sw} * {sh}) AS FLOAT), 1) ELSE CAST(0 AS FLOAT) END"


def body(rel: str) -> str:
    """Upper median font size of a page's spans with letters."""
    return f"""SELECT p.doc_id, p.page_index, coalesce(m.body, CAST(10 AS FLOAT)) AS body FROM (SELECT DISTINCT doc_id, page_index FROM {rel}) p LEFT JOIN (
 SELECT doc_id, page_index, list_sort(list(font_size))[count(*) // 2 + 1] AS body FROM {rel} WHERE font_size BETWEEN 5 AND 24 AND {letters('text')} > 0 GROUP BY ALL) m USING (doc_id, page_index)"""

def columns(rel: str) -> str:
    """Counts of wide spans left and right of the middle."""
    return f"""SELECT doc_id, page_index, count(*) FILTER (wide AND l) AS n_left, count(*) FILTER (wide AND NOT l AND r) AS n_right, count(*) FILTER (wide AND NOT l AND NOT r) AS n_crossing,
 n_left >= 4 AND n_right >= 4 AND n_crossing <= 2 AS two_columns
FROM (SELECT *, width >= CAST(122.4 AS FLOAT) AND {letters('text')} >= 20 AS wide, x + width < 301 AS l, x > 311 AS r FROM {rel}) GROUP BY doc_id, page_index"""
