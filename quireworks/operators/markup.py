"""Operators that edit markup in order: headings, figures, equations, algorithms, language tags, previews.

The editing is inherently sequential per page, so each operator is a function
of one markup string over tokens from a regular expression; ``as_column``
wraps it as an Arrow-batched pandas function.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from posixpath import normpath
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import KNOWN_SECTIONS, NOT_SECTIONS

TAG = re.compile(r"<(/?)\s*([^\s/>!?]*)[^>]*?(/?)\s*>")
PARAGRAPH = re.compile(r"<p>(.*?)</p>", re.S)
ANY_PARAGRAPH = re.compile(r"<p[^>]*>(.*?)</p>", re.S)
#: Elements that shelter paragraphs from becoming headings; elements without an end tag.
CONTAINERS = {"blockquote", "div", "figure", "li", "td", "th"}
VOID = {"br", "hr", "img", "input"}
ENDING = ".:;,"
NOT_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def as_column(function: Callable[..., str | None]):
    """A pandas function of string columns that applies ``function`` to each row; nulls stay null."""

    @F.pandas_udf(StringType())
    def run(first: pd.Series, *more: pd.Series) -> pd.Series:  # noqa: ANN002
        rows = zip(first, *more, strict=True)
        return pd.Series([None if r[0] is None else function(*r) for r in rows], dtype=object)

    return run


def escape(text: str) -> str:
    return html.escape(NOT_XML.sub("", text), quote=True).replace("&#x27;", "&apos;")


def visible(markup: str) -> str:
    """Text of markup, as the column function ``strip_markup`` sees it."""
    text = re.sub(r"<[^>]*$", "", re.sub(r"<[^>]*>|>", " ", markup))
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = text.replace(name, char)
    return " ".join(text.split())


def _depth(fragment: str, depth: int, counts: Callable[[str], bool]) -> int:
    """Open elements after ``fragment``; never below zero."""
    for close, name, alone in TAG.findall(fragment):
        if name and counts(name):
            depth = max(depth - 1, 0) if close else depth + (not alone)
    return depth


def strong_prefix(content: str) -> tuple[int, list[str]] | None:
    """(end, parts) of the leading run of bold parts: ten at most, 512 bytes each, none blank."""
    parts, at = [], 0
    while content.startswith("<strong>", at):
        end = content.find("</strong>", at)
        inner = content[at + 8 : end]
        text = visible(inner)
        if end < 0 or len(parts) == 10 or len(inner.encode()) > 512 or not text:
            return None
        parts.append(text)
        at = end + 9
        at += len(content[at:]) - len(content[at:].lstrip())
    return (at, parts) if parts else None


def _prose(markup: str, limit: int = 256) -> tuple[int, int]:
    """(letters, words) among the first visible characters; an entity is one character and ends a word."""
    seen = re.sub(r"&[^;<>]*;", "\0", re.sub(r"<[^>]*(>|$)", "\1", markup))
    out, n = [], 0
    for c in seen:
        if c != "\1":
            n += 1
            if n > limit:
                break
        out.append(c)
    found = re.findall(r"[^\W\d_]+", "".join(out))
    return sum(map(len, found)), len(found)


def is_appendix(parts: list[str], body: str) -> bool:
    first, *rest = " ".join(parts).split() or [""]
    letter = next((c for w in rest for c in w if c.isalpha()), "")
    return not body.strip() and len(parts) >= 3 and len(rest) >= 2 and bool(re.fullmatch(r"[A-Z](\.[0-9]+)*", first)) and letter.isupper()


def is_section(parts: list[str], body: str) -> bool:
    """Whether bold parts that lead a paragraph with ``body`` behind them are a section heading."""
    text = " ".join(parts).strip()
    words, letters = text.split(), [c for c in text if c.isalpha()]
    if len(text) > 120 or not 4 <= len(letters) <= 96 or len(words) > 10:
        return False
    label = next((re.sub(r"^[\W\d_]+|[\W\d_]+$", "", w).upper() for w in words if any(map(str.isalpha, w))), "")
    if label in NOT_SECTIONS:
        return False
    numbered = bool(re.fullmatch(r"[0-9.:\-]*[0-9][0-9.:\-]*", words[0]))
    capital = any(map(str.isupper, text)) and not any(map(str.islower, letters)) and (len(words) > 1 or len(letters) >= 7)
    n_letters, n_words = _prose(body)
    known = text.rstrip(ENDING).upper() in KNOWN_SECTIONS and n_letters >= 24 and n_words >= 5
    return numbered or capital or is_appendix(parts, body) or known


def _paragraphs(markup: str) -> Iterator[tuple[str, str | None, int]]:
    """(text before, content of a plain paragraph or None at the end, container depth)."""
    at = depth = 0
    for m in PARAGRAPH.finditer(markup):
        before = markup[at : m.start()]
        depth = _depth(before, depth, CONTAINERS.__contains__)
        yield before, m[1], depth
        at = m.end()
    yield markup[at:], None, depth


def promote_run_in_headings(markup: str) -> str:
    """Bold runs that lead a paragraph and read as section headings become ``<h2>``."""
    out = []
    for before, content, depth in _paragraphs(markup):
        out.append(before)
        if content is None:
            break
        found = strong_prefix(content) if depth == 0 else None
        body = content[found[0] :].lstrip() if found else ""
        if found and is_section(found[1], body):
            text = " ".join(found[1])
            if text.strip().rstrip(ENDING).upper() in KNOWN_SECTIONS:
                text = text.rstrip(ENDING).rstrip()
            out.append(f"<h2>{escape(text)}</h2>" + (f"\n<p>{body}</p>" if body else ""))
        else:
            out.append(f"<p>{content}</p>")
    return "".join(out)


def demote_heading(markup: str, level: int, heading: str) -> str:
    """The only heading of this level and text becomes a bold paragraph; several stay."""
    old = f"<h{level}>{escape(heading)}</h{level}>"
    return markup.replace(old, f"<p><strong>{escape(heading)}</strong></p>") if 1 <= level <= 6 and markup.count(old) == 1 else markup


def repair_heading(markup: str, level: int, original: str, whole: str, inserted: list[str], context: str) -> str:
    """Puts words that strayed behind ``context`` as bold runs back into their heading; no-op unless both are unique."""
    if not 1 <= level <= 6 or not 1 <= len(inserted) <= 4:
        return markup
    old, new = (f"<h{level}>{escape(t)}</h{level}>" for t in (original, whole))
    run = " ".join(f"<strong>{escape(w)}</strong>" for w in inserted)
    strays = [m for m in re.finditer(re.escape(escape(context)) + r"(\s{0,8})" + re.escape(run), markup)]
    if markup.count(old) != 1 or len(strays) != 1:
        return markup
    end = strays[0].end()
    edits = sorted([(markup.index(old), len(old), new), (end - len(run), len(run), "")], reverse=True)
    for at, n, text in edits:
        markup = markup[:at] + text + markup[at + n :]
    return markup


def _strong_runs(content: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, text) of bold runs outside other inline elements."""
    at = 0
    while (start := content.find("<strong>", at)) >= 0:
        outside = _depth(content[:start], 0, lambda n: n not in VOID) == 0
        found = strong_prefix(content[start:]) if outside else None
        if found:
            yield start, start + found[0], " ".join(found[1])
        at = start + max(found[0] if found else 0, 8)


def _fragment(text: str) -> str:
    return f"<p>{text.strip()}</p>\n" if text.strip() else ""


def promote_positioned_headings(markup: str, headings: list[str]) -> str:
    """Headings known from their place on the page become ``<h2>`` where they occur once, bold or plain, outside containers."""
    if not headings:
        return markup
    plain, bold = dict.fromkeys(headings, 0), dict.fromkeys(headings, 0)
    for _, content, depth in _paragraphs(markup):
        if content is None or depth:
            continue
        for h in headings:
            plain[h] += 0 if re.search("[<>]", content) else content.count(escape(h))
        for _, _, text in _strong_runs(content):
            if text in bold:
                bold[text] += 1
    once = {h for h in headings if plain[h] + bold[h] == 1}
    title = lambda h: f"<h2>{escape(h.rstrip(ENDING).rstrip())}</h2>"
    out = []
    for before, content, depth in _paragraphs(markup):
        out.append(before)
        if content is None:
            break
        new = None
        if depth == 0:
            runs = [r for r in _strong_runs(content) if r[2] in once]
            if len(runs) == 1:
                start, end, h = runs[0]
                body = content[end:].lstrip()
                new = _fragment(content[:start]) + title(h) + (f"\n<p>{body}</p>" if body else "")
            elif not re.search("[<>]", content):
                places = sorted((m.start(), m.end(), h) for h in once if (m := re.search(rf"(?<!\S){re.escape(escape(h))}(?!\S)", content)))
                pieces, at = [], 0
                for start, end, h in places:
                    if start >= at:
                        pieces.append(_fragment(content[at:start]) + title(h) + "\n")
                        at = end
                if pieces:
                    new = ("".join(pieces) + _fragment(content[at:])).removesuffix("\n")
        out.append(f"<p>{content}</p>" if new is None else new)
    return "".join(out)


def algorithm_blocks(markup: str) -> str:
    """An algorithm's paragraph and the numbered ones right behind it become one preformatted block."""
    numbered = re.compile(r"<strong>[1-9][0-9]?(</strong>| )")
    out, at = [], 0
    while (start := markup.find("<p><strong>Algorithm</strong>", at)) >= 0:
        end = markup.find("</p>", start)
        if end < 0:
            break
        parts, end = [markup[start + 3 : end]], end + 4
        while (m := re.compile(r"\s*<p>(.*?)</p>", re.S).match(markup, end)) and numbered.search(m[1]):
            parts.append(m[1])
            end = m.end()
        block = '<pre class="algorithm">' + "\n".join(parts) + "</pre>"
        head = block.find(":</strong>")
        head = head + 10 if head >= 0 else len("<p><strong>Algorithm</strong>")
        code = re.sub(r" (<strong>[1-9][0-9]?(?:</strong>)? )", r"\n\1", block[head:])
        out.append(markup[at:start] + (block[:head] + code).replace("**", ""))
        at = end
    return "".join(out) + markup[at:]


def place_figure(markup: str, marker: str, source: str, alt: str) -> str | None:
    """The first paragraph whose text starts with ``marker`` becomes the figure's caption; None without one."""
    for m in ANY_PARAGRAPH.finditer(markup):
        if visible(m[1]).startswith(marker):
            figure = f'<figure class="figure-fallback"><img src="{source}" alt="{alt}"/><figcaption>{m[1]}</figcaption></figure>'
            return markup[: m.start()] + figure + markup[m.end() :]
    return None


def find_anchor(markup: str, anchor: str) -> tuple[re.Match, int] | None:
    """The only paragraph whose text ends with ``anchor``, and where the anchor starts in its content."""
    found = [m for m in ANY_PARAGRAPH.finditer(markup) if visible(m[1]).endswith(anchor)]
    if len(found) != 1:
        return None
    at = found[0][1].rfind(anchor)
    return (found[0], at) if at >= 0 and not found[0][1][at + len(anchor) :].strip() else None


def place_equation(markup: str, anchor: str, source: str, alt: str) -> str | None:
    """The anchor's paragraph becomes the equation's image; prose before the anchor stays a paragraph."""
    found = find_anchor(markup, anchor)
    if not found:
        return None
    m, at = found
    figure = f'<figure class="equation-fallback"><img src="{source}" alt="{alt}"/></figure>'
    lead = m[1][:at].rstrip()
    if visible(lead):
        figure = markup[m.start() : m.start(1)] + f"{lead}</p>\n{figure}"
    return markup[: m.start()] + figure + markup[m.end() :]


def anchors_unique(markup: str, anchors: list[str]) -> bool:
    """Whether every anchor names a paragraph of its own."""
    found = [find_anchor(markup, a) for a in anchors]
    return all(found) and len({f[0].start() for f in found}) == len(found)


class LostAnchor(ValueError):
    """An equation's text was taken out, but its place is gone."""


def page_body(number: int, markup: str, images: list[dict]) -> str:
    """The body of a page with its images (href, alt, kind, marker) in place; those without one follow in a section."""
    body, rest = markup, []
    for image in images:
        source, alt = "../" + escape(image["href"]), escape(image["alt"])
        place = {"caption": place_figure, "equation": place_equation}.get(image["kind"])
        placed = place(body, image["marker"], source, alt) if place else None
        if placed is not None:
            body = placed
        elif image["kind"] == "equation":
            raise LostAnchor(f"equation anchor lost on page {number}")
        elif image["kind"] == "page":
            rest.append(f'<figure class="visual-page-fallback"><img src="{source}" alt="{alt}"/></figure>\n')
        else:
            rest.append(f'<figure class="figure-fallback"><img src="{source}" alt="{alt}"/><figcaption>{alt}</figcaption></figure>\n')
    section = f'<section class="page-images" aria-label="Images of this page">\n{"".join(rest)}</section>\n' if rest else ""
    mark = f'<p id="page-{number}" class="source-page" epub:type="pagebreak" role="doc-pagebreak" aria-label="{number}">Source page {number}</p>\n'
    return f'<main class="source-page-content" data-source-page="{number}">\n{mark}{body}{section}</main>\n'


# language tags ------------------------------------------------------------------------------------

LANGUAGE = re.compile(
    r"(?P<lang>[a-z]{2,3}(?:-[a-z]{3}){0,3}|[a-z]{4,8})(?:-(?P<script>[a-z]{4}))?(?:-(?P<region>[a-z]{2}|[0-9]{3}))?"
    r"(?P<variants>(?:-(?:[a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*)(?P<extensions>(?:-[0-9a-wy-z](?:-[a-z0-9]{2,8})+)*)(?P<private>-x(?:-[a-z0-9]{1,8})+)?|x(?:-[a-z0-9]{1,8})+", re.I)


def language_tag(value: str | None) -> str | None:
    """A well-formed BCP 47 tag in canonical case; null for any other.  Subtags are not looked up in the registry."""
    value = (value or "").strip()
    m = LANGUAGE.fullmatch(value) if value and len(value.encode()) <= 255 else None
    if not m:
        return None
    parts = value.lower().split("-")
    singles = [p for p in parts[1:] if len(p) == 1]
    variants = (m["variants"] or "").lower().split("-")[1:]
    if len(set(singles) - {"x"}) != len([s for s in singles if s != "x"]) and parts[0] != "x" or len(set(variants)) != len(variants):
        return None
    out, extended = [], parts[0] == "x"
    for i, p in enumerate(parts):
        extended = extended or (i > 0 and len(p) == 1)
        out.append(p if extended or i == 0 else p.title() if len(p) == 4 and p.isalpha() else p.upper() if len(p) == 2 else p)
    return "-".join(out)


def language_or_default(value: str | None) -> str:
    return language_tag(value) or "en"


# previews --------------------------------------------------------------------------------------------

#: Elements, attributes and picture types a preview treats specially.
ACTIVE = {"script", "iframe", "object", "embed", "applet", "form", "input", "button", "select", "textarea", "link", "base", "audio", "video", "source", "track", "style", "frame"}
UNSAFE = {"style", "srcdoc", "formaction", "action", "poster", "xlink:href", "href", "target", "ping", "download"}
PICTURES = {"image/gif", "image/jpeg", "image/png", "image/webp"}


class _Preview(HTMLParser):
    def __init__(self, assets: dict[str, str], chapter: str):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.skip: list[str] = []
        self.assets, self.chapter = assets, chapter

    def _start(self, tag: str, attrs: list[tuple[str, str | None]], end: str) -> None:
        if self.skip or tag in ACTIVE or (tag == "meta" and any(n == "http-equiv" for n, _ in attrs)):
            if tag in ACTIVE and not end and tag not in VOID | {"link", "base", "embed", "source", "track", "frame"}:
                self.skip.append(tag)
            return
        kept = []
        for name, value in attrs:
            if name.startswith("on") or name in UNSAFE:
                continue
            if name == "src":
                path = resolve_path(self.chapter, value or "")
                if path is None or self.assets.get(path) not in PICTURES:
                    continue
                value = path
            kept.append(f' {name}="{html.escape(value or "")}"')
        self.out.append(f"<{tag}{''.join(kept)}{end}>")

    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs, "")

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs, "/")

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
        elif tag not in ACTIVE:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def sanitize_preview(markup: str, assets: dict[str, str], chapter: str = "text/page-0001.xhtml") -> str:
    """Chapter markup without active content; pictures must be among ``assets`` (path to media type)."""
    parser = _Preview(assets, chapter)
    parser.feed(markup)
    parser.close()
    return "".join(parser.out)


def resolve_path(chapter: str, href: str) -> str | None:
    """The path in the book that ``href`` names from ``chapter``; None if it leaves the book."""
    parts = urlsplit(href)
    if parts.scheme or parts.netloc or not parts.path or parts.path.startswith("/"):
        return None
    path = normpath(chapter.rsplit("/", 1)[0] + "/" + unquote(parts.path)) if "/" in chapter else normpath(unquote(parts.path))
    return None if path.startswith("..") else path


def manifest_problem(manifest: dict) -> str | None:
    """What is wrong with a preview (stylesheet, chapters, assets); None if nothing."""
    if not isinstance(manifest.get("stylesheet"), str) or len(manifest["stylesheet"].encode()) > 512 * 1024:
        return "stylesheet"
    chapters = manifest.get("chapters")
    if not isinstance(chapters, list) or not chapters:
        return "chapters"
    for c in chapters:
        if not all(isinstance(c.get(k), str) for k in ("title", "href", "xhtml")) or len(c["xhtml"].encode()) > 2 * 1024 * 1024:
            return "chapter"
    for a in manifest.get("assets") or []:
        if not isinstance(a.get("href"), str) or a.get("mediaType") not in PICTURES or resolve_path("text/x", "../" + a["href"]) is None:
            return "asset"
    return None
