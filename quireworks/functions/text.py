"""Text and markup functions as Spark columns.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a character class that Java and RE2 read alike.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Characters that XML 1.0 does not allow.
NOT_XML = r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"
#: Characters that count as mathematical syntax.
MATH_SYNTAX = "=+()[]{}−±×÷<>≤≥≠≈∝←→∑∏∫√∈∉⊂⊆∪∩"
#: Labels that never start a section.
NOT_SECTIONS = [
    "ALGORITHM", "CAUTION", "DEFINITION", "EQUATION", "EXAMPLE", "FIGURE", "IMPORTANT", "LEMMA", "NOTE", "PROOF", "REMARK", "TABLE", "THEOREM", "WARNING"]
#: Labels that start a section where prose follows.
KNOWN_SECTIONS = ["ABSTRACT", "ACKNOWLEDGEMENTS", "ACKNOWLEDGMENTS", "DECODER", "ENCODER"]
DEFAULT_TITLE = "Converted document"


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def strip_markup(markup: Column) -> Column:
    """Visible text: tags and stray ``>`` become spaces, an unclosed ``<`` takes the rest, four entities are decoded in order."""
    text = F.regexp_replace(F.regexp_replace(markup, "<[^>]*>|>", " "), "<[^>]*$", "")
    for name, char in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"')):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return collapse(text)


def visible_length(markup: Column) -> Column:
    return F.length(F.replace(strip_markup(markup), F.lit(" "), F.lit("")))


def has_text(markup: Column) -> Column:
    return visible_length(markup) >= 20


def keep_xml(text: Column) -> Column:
    return F.regexp_replace(text, NOT_XML, "")


def escape_xml(text: Column) -> Column:
    text = keep_xml(text)
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        text = F.replace(text, F.lit(char), F.lit(f"&{name};"))
    return text


def normalized_title(title: Column) -> Column:
    """Trimmed, without characters XML forbids, at most 300 characters; blank titles get a default."""
    trimmed = F.regexp_replace(title, f"^{SPACE}+|{SPACE}+$", "")
    cut = F.substring(keep_xml(trimmed), 1, 300)
    blank = cut.isNull() | (F.regexp_replace(cut, SPACE, "") == "")
    return F.when(blank, F.lit(DEFAULT_TITLE)).otherwise(cut)


def headings(markup: Column) -> Column:
    """``array<struct<level, text>>`` of attribute-free headings in document order, with two letters or digits at least."""
    found = F.regexp_extract_all(markup, F.lit(r"(?s)<h1>.*?</h1>|<h2>.*?</h2>|<h3>.*?</h3>|<h4>.*?</h4>|<h5>.*?</h5>|<h6>.*?</h6>"), F.lit(0))
    rows = F.transform(found, lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), F.substring(strip_markup(h), 1, 120).alias("text")))
    return F.filter(rows, lambda r: F.length(F.regexp_replace(r["text"], r"[^\p{L}\p{N}]", "")) >= 2)


def first_heading(markup: Column) -> Column:
    return F.try_element_at(headings(markup), F.lit(1))["text"]


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}", ""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def heading_label(text: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", ""), "[.:;,]+$", ""))


def is_section_heading(text: Column, body: Column) -> Column:
    """Whether a bold run before ``body`` (visible text) reads as a section heading; appendices are judged elsewhere."""
    text = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    w, n = words(text), letters(text)
    named = F.try_element_at(F.filter(w, lambda x: x.rlike(r"\p{L}")), F.lit(1))
    label = F.upper(F.regexp_replace(named, r"^\P{L}+|\P{L}+$", ""))
    plausible = (F.length(text) <= 120) & n.between(4, 96) & (F.size(w) <= 10) & ~F.coalesce(label.isin(NOT_SECTIONS), F.lit(False))
    first = F.coalesce(F.try_element_at(w, F.lit(1)), F.lit(""))
    numbered = first.rlike(r"^[0-9.:\-]*[0-9][0-9.:\-]*$")
    capital = text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}") & ((F.size(w) > 1) | (n >= 7))
    seen = F.substring(body, 1, 256)
    prose = (letters(seen) >= 24) & (F.size(F.filter(F.split(seen, r"\P{L}+"), lambda x: x != "")) >= 5)
    return plausible & (numbered | capital | (heading_label(text).isin(KNOWN_SECTIONS) & prose))


def is_safe_link(href: Column) -> Column:
    href = F.regexp_replace(href, f"^{SPACE}+|{SPACE}+$", "")
    before = F.regexp_extract(href, "^([^:/#?]*):", 1)
    scheme = href.rlike("^[^:/#?]*:")
    return ~href.rlike(r"[\x00-\x1f\x7f-\x{9f}]") & (~scheme | F.lower(before).isin("http", "https", "mailto"))


def math_syntax_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, MATH_SYNTAX, ""))


def is_trustworthy_block(tag: Column, markup: Column) -> Column:
    """Prose that extraction got right: enough letters and words, no mathematical syntax, no replacement character."""
    text = strip_markup(markup)
    real = F.size(F.filter(F.transform(words(text), letters), lambda n: n >= 2))
    return (letters(text) >= 12) & (real >= F.when(tag == "p", 5).otherwise(2)) & (math_syntax_count(text) == 0) & ~text.contains("�")


def is_equation_number(text: Column) -> Column:
    text = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    return text.rlike(r"^\([0-9a-z]{1,6}\)$") & text.rlike("[0-9]")


#: Marks in font names and symbols that make a span mathematical; relation signs; labels that veto an equation.
MATH_FONTS = ["math", "cmmi", "cmsy", "cmex", "txmi", "txsy", "txex", "msam", "msbm"]
MATH_SYMBOLS = "∑∏∫√≤≥≠≈∞∈∉⊂⊆∪∩∀∃⇒⇔→←"
RELATIONS = "=<>≤≥≠≈∝←→"
VETO_LABELS = ["Figure ", "Fig. ", "Table ", "Algorithm ", "Listing ", "Input:", "Output:", "parameter:"]


def is_math_span(font: Column, text: Column) -> Column:
    return F.lower(font).rlike("|".join(MATH_FONTS)) | text.rlike(f"[{MATH_SYMBOLS}]")


def has_relation(text: Column) -> Column:
    return text.rlike(f"[{RELATIONS}]")


def is_mixed_prose(font: Column, text: Column) -> Column:
    """At least five words with a letter outside mathematical spans."""
    return (F.size(F.filter(words(text), lambda w: w.rlike(r"\p{L}"))) >= 5) & ~is_math_span(font, text)


def is_veto_label(text: Column) -> Column:
    start = F.regexp_replace(text, f"^{SPACE}+", "")
    found = F.lit(False)
    for label in VETO_LABELS:
        found = found | start.startswith(label)
    return found


def may_have_caption(text: Column) -> Column:
    return F.exists(words(text), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")).isin("figure", "fig"))


def running_text(text: Column) -> Column:
    """Text without ASCII digits, white space collapsed, in lower case."""
    return F.lower(collapse(F.regexp_replace(text, "[0-9]", "")))


def heading_token(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def title_text(text: Column) -> Column:
    return collapse(text)


def bounded_suffix(text: Column, n: int) -> Column:
    return F.regexp_replace(F.substring(text, -n, n), f"^{SPACE}+|{SPACE}+$", "")


def format_bytes(n: Column) -> Column:
    one = lambda x: F.format_string("%.1f", F.round(x, 1))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(
        n < 1024 * 1024, F.concat(one(n / 1024), F.lit(" KiB"))).otherwise(F.concat(one(n / (1024 * 1024)), F.lit(" MiB")))


def diagnostic_token(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9_.-]", ""), 1, 64)


def xhtml_document(title: Column, language: Column, body: Column) -> Column:
    lang = escape_xml(language)
    return F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="'), lang, F.lit('" lang="'), lang,
        F.lit('">\n<head><title>'), escape_xml(title), F.lit('</title><link rel="stylesheet" type="text/css" href="../styles.css"/></head>\n<body>'), body, F.lit("</body>\n</html>\n"))


def image_media_type(href: Column) -> Column:
    return F.when(href.rlike(r"\.jpe?g$"), F.lit("image/jpeg")).otherwise(F.lit("image/png"))


def output_format(asked: Column, path: Column) -> Column:
    return F.coalesce(asked, F.when(F.lower(path).endswith(".pdf"), F.lit("pdf")).otherwise(F.lit("epub")))


def file_stem(path: Column) -> Column:
    """Name without its last suffix; a name that only starts with a dot is its own stem."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")


def input_title(path: Column) -> Column:
    stem = file_stem(path)
    return F.when(F.coalesce(stem, F.lit("")) == "", F.lit(DEFAULT_TITLE)).otherwise(stem)
