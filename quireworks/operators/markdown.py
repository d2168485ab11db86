"""Markdown of extracted pages to XHTML: a subset that layout extraction produces.

Blocks: headings, paragraphs, lists (with tasks), quotes, rules, fenced code,
tables, footnote definitions.  Inline: code, strong, emphasis, strikethrough,
links, footnotes.  Raw HTML is text, unsafe links lose their destination, and
pictures leave only their label.
"""

from __future__ import annotations

import re

from .markup import escape, promote_run_in_headings

SCHEMES = {"http", "https", "mailto"}
BLOCK = re.compile(r"^(#{1,6})\s+(.*?)\s*#*$|^(```|~~~)|^(\s*[-*+]|\s*\d+[.)])\s+|^>|^([-*_])(\s*\5){2,}\s*$")


def safe_destination(href: str) -> str:
    href = href.strip()
    if any(ord(c) < 32 or 127 <= ord(c) < 160 for c in href):
        return ""
    m = re.match(r"[^:/#?]*:", href)
    return href if not m or m[0][:-1].lower() in SCHEMES else ""


def smart(text: str) -> str:
    """Typographic quotes, dashes and ellipses."""
    text = text.replace("...", "…").replace("---", "—").replace("--", "–")
    text = re.sub(r'(^|[\s(\[{])"', "\\1“", text).replace('"', "”")
    return re.sub(r"(^|[\s(\[{])'", "\\1‘", text).replace("'", "’")


def inline(text: str) -> str:
    held: list[str] = []

    def hold(markup: str) -> str:
        held.append(markup)
        return f"\0{len(held) - 1}\0"

    text = text.replace("\0", "")
    text = re.sub(r"(`+)(.+?)\1(?!`)", lambda m: hold(f"<code>{escape(m[2].strip())}</code>"), text)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: hold(escape(m[1])), text)
    text = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"\[\^([^\]\s]+)\]", lambda m: hold(f'<sup class="footnote-reference"><a href="#{escape(m[1])}">{escape(m[1])}</a></sup>'), text)
    text = re.sub(r"\[([^\]]+)\]\(\s*<?([^)\s>]*)>?(?:\s+\"[^\"]*\")?\s*\)", lambda m: hold(f'<a href="{escape(safe_destination(m[2]))}">') + m[1] + hold("</a>"), text)
    for mark, tag in ((r"\*\*|__", "strong"), (r"~~", "del"), (r"\*|(?<!\w)_|_(?!\w)", "em")):
        text = re.sub(rf"({mark})(?=\S)(.+?)(?<=\S)\1", lambda m, t=tag: hold(f"<{t}>") + m[2] + hold(f"</{t}>"), text, flags=re.S)
    out = escape_text(smart(text))
    while "\0" in out:
        out = re.sub(r"\0(\d+)\0", lambda m: held[int(m[1])], out)
    return out


def escape_text(text: str) -> str:
    """Element content: control marks of ``inline`` pass."""
    return "".join(p if i % 2 else escape(p).replace("&quot;", '"').replace("&apos;", "'") for i, p in enumerate(re.split(r"(\0\d+\0)", text)))


def _cells(line: str) -> list[str]:
    return [c.strip() for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]


def blocks(lines: list[str]) -> list[str]:
    out, i = [], 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := re.match(r"^(#{1,6})\s+(.*?)\s*#*$", line):
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
            i += 1
        elif m := re.match(r"^(```|~~~)", line):
            end = next((j for j in range(i + 1, len(lines)) if lines[j].startswith(m[1])), len(lines))
            out.append(f"<pre><code>{escape(chr(10).join(lines[i + 1 : end]) + chr(10))}</code></pre>")
            i = end + 1
        elif re.match(r"^\s*([-*_])(\s*\1){2,}\s*$", line):
            out.append("<hr/>")
            i += 1
        elif line.lstrip().startswith(">"):
            end = next((j for j in range(i, len(lines)) if not lines[j].lstrip().startswith(">")), len(lines))
            out.append("<blockquote>\n" + "\n".join(blocks([re.sub(r"^\s*>\s?", "", x) for x in lines[i:end]])) + "\n</blockquote>")
            i = end
        elif m := re.match(r"^\[\^([^\]\s]+)\]:\s*(.*)$", line):
            out.append(f'<div class="footnote-definition" id="{escape(m[1])}"><sup class="footnote-definition-label">{escape(m[1])}</sup>\n<p>{inline(m[2])}</p>\n</div>')
            i += 1
        elif "|" in line and i + 1 < len(lines) and re.match(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[i + 1]):
            end = next((j for j in range(i + 2, len(lines)) if "|" not in lines[j] or not lines[j].strip()), len(lines))
            row = lambda x, t: "<tr>" + "".join(f"<{t}>{inline(c)}</{t}>" for c in _cells(x)) + "</tr>"
            body = "\n".join(row(x, "td") for x in lines[i + 2 : end])
            out.append(f"<table><thead>{row(line, 'th')}</thead><tbody>\n{body}\n</tbody></table>")
            i = end
        elif m := re.match(r"^(\s*)([-*+]|\d+[.)])\s+", line):
            ordered, items = m[2][0].isdigit(), []
            while i < len(lines) and (m := re.match(r"^(\s*)([-*+]|\d+[.)])\s+(.*)$", lines[i])) and m[2][0].isdigit() == ordered:
                item, i = [m[3]], i + 1
                while i < len(lines) and lines[i].strip() and not BLOCK.match(lines[i]):
                    item.append(lines[i].strip())
                    i += 1
                task = re.match(r"^\[([ xX])\]\s+(.*)$", item[0])
                box = f'<input disabled="" type="checkbox"{" checked=" + chr(34) * 2 if task[1] != " " else ""}/>\n' if task else ""
                items.append(f"<li>{box}{inline(chr(10).join([task[2] if task else item[0], *item[1:]]))}</li>")
            tag = "ol" if ordered else "ul"
            out.append(f"<{tag}>\n" + "\n".join(items) + f"\n</{tag}>")
        else:
            end = i + 1
            while end < len(lines) and lines[end].strip() and not BLOCK.match(lines[end]):
                end += 1
            out.append(f"<p>{inline(chr(10).join(x.strip() for x in lines[i:end]))}</p>")
            i = end
    return out


def markdown_to_xhtml(markdown: str) -> str:
    """XHTML of a page's Markdown, with run-in section headings promoted."""
    return promote_run_in_headings("".join(b + "\n" for b in blocks(markdown.splitlines())))
