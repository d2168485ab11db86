"""A small PDF reader: pages, text spans and pictures of plain files.

It reads files with a classic cross-reference table, Flate or plain streams,
and simple fonts: enough for synthetic documents and for the raster documents
this package writes.  What it cannot read becomes a warning row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?[0-9]*\.?[0-9]+|[A-Za-z'\"*]+", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class ParseError(ValueError):
    """A file that is no PDF this reader understands."""


def _string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    def one(m: re.Match) -> bytes:
        if m[1][:1].isdigit():
            return bytes([int(m[1], 8) & 255])
        return ESCAPES.get(m[1], b"" if m[1] in b"\r\n" else m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw[1:-1], flags=re.S).decode("latin-1")


class Document:
    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF-"):
            raise ParseError("not a PDF file")
        self.objects = {int(m[1]): m[3] for m in OBJECT.finditer(data)}
        root = re.search(rb"trailer.*?/Root\s+(\d+)\s+\d+\s+R", data, re.S)
        if not root or int(root[1]) not in self.objects:
            raise ParseError("no document catalog")
        tree = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", self.objects[int(root[1])])
        self.pages = list(self._leaves(int(tree[1]), set(), None)) if tree else []

    def _leaves(self, n: int, seen: set[int], box: list[float] | None) -> Iterator[tuple[int, list[float]]]:
        body = self.objects.get(n, b"")
        if n in seen:
            return
        seen.add(n)
        m = re.search(rb"/MediaBox\s*\[([^\]]*)\]", body)
        box = [float(v) for v in m[1].split()] if m else box
        kids = re.search(rb"/Kids\s*\[([^\]]*)\]", body)
        if kids:
            for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]):
                yield from self._leaves(int(k), seen, box)
        elif body:
            yield n, box or [0.0, 0.0, 612.0, 792.0]

    def stream(self, n: int) -> bytes:
        body = self.objects.get(n, b"")
        m = re.search(rb"stream\r?\n(.*)\r?\nendstream", body, re.S)
        if not m:
            return b""
        return zlib.decompress(m[1]) if b"/FlateDecode" in body[: m.start()] else m[1]

    def contents(self, page: int) -> bytes:
        m = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|(\d+)\s+\d+\s+R)", self.objects[page])
        refs = re.findall(rb"(\d+)\s+\d+\s+R", m[1]) if m and m[1] is not None else [m[2]] if m else []
        return b"\n".join(self.stream(int(r)) for r in refs)

    def fonts(self, page: int) -> dict[str, str]:
        body = self.objects[page]
        m = re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", body)
        body = self.objects.get(int(m[1]), b"") if m else body
        found = {}
        for name, ref in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", body):
            base = re.search(rb"/BaseFont\s*/([^\s/<>]+)", self.objects.get(int(ref), b""))
            if base:
                found[name.decode()] = base[1].decode()
        return found

    def spans(self, page: int) -> Iterator[tuple[str, float, float, float, float, str]]:
        """(text, x, y, width, size, font) of shown strings; widths are half an em a character."""
        fonts, stack, array = self.fonts(page), [], None
        font, size, lead, x, y, x0, y0 = "", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
        for m in TOKEN.finditer(self.contents(page)):
            t = m[0]
            if t == b"[":
                array = []
            elif t == b"]":
                stack, array = [*stack, array], None
            elif t[:1] in b"(<":
                (stack if array is None else array).append(_string(t))
            elif re.fullmatch(rb"[-+]?[0-9]*\.?[0-9]+", t):
                (stack if array is None else array).append(float(t))
            elif t[:1] == b"/":
                stack.append(t[1:].decode("latin-1"))
            else:
                op = t.decode("latin-1")
                if op == "BT":
                    x = y = x0 = y0 = 0.0
                elif op == "Tf" and len(stack) >= 2:
                    font, size = fonts.get(stack[-2], stack[-2]), stack[-1]
                elif op == "TL" and stack:
                    lead = stack[-1]
                elif op in ("Td", "TD") and len(stack) >= 2:
                    x0, y0 = x0 + stack[-2], y0 + stack[-1]
                    lead = -stack[-1] if op == "TD" else lead
                    x, y = x0, y0
                elif op == "Tm" and len(stack) >= 6:
                    x = x0 = stack[-2]
                    y = y0 = stack[-1]
                elif op == "T*":
                    y0 -= lead
                    x, y = x0, y0
                elif op in ("Tj", "TJ", "'") and stack:
                    if op == "'":
                        y0 -= lead
                        x, y = x0, y0
                    shown = stack[-1]
                    text = shown if isinstance(shown, str) else "".join(s if isinstance(s, str) else " " if s < -200 else "" for s in shown)
                    width = 0.5 * size * len(text)
                    if text:
                        yield text, x, y, width, size, font
                    x += width
                stack = []

    def picture(self, page: int) -> tuple[int, int, bytes] | None:
        """(width, height, RGB) of a page that shows one 8-bit RGB picture."""
        for ref in re.findall(rb"(\d+)\s+\d+\s+R", self.objects[page]):
            body = self.objects.get(int(ref), b"")
            if b"/Subtype /Image" in body and b"/DeviceRGB" in body:
                w, h = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"Width", b"Height"))
                return w, h, self.stream(int(ref))
        return None


SPANS = ("path string, page_index long, span_index long, text string, x float, y float, width float, height float, font_name string, font_size float, font_weight int, "
         "media_x0 float, media_y0 float, media_x1 float, media_y1 float, error string")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in SPANS.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                document = Document(bytes(content))
                if not document.pages:
                    raise ParseError("a document without pages")
                for p, (n, box) in enumerate(document.pages):
                    found = list(document.spans(n))
                    for i, (text, x, y, w, size, font) in enumerate(found):
                        rows.append((path, p, i, text, x, y, w, size, font, size, 700 if "bold" in font.lower() else 400, *box, None))
                    if not found:
                        rows.append((path, p, None, None, None, None, None, None, None, None, None, *box, None))
            except (ParseError, zlib.error, ValueError) as e:
                rows.append((path, *[None] * 14, str(e)))
        out = pd.DataFrame(rows, columns=names)
        yield out.astype({"page_index": "Int64", "span_index": "Int64", "font_weight": "Int32"})


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Spans of the PDF files under ``path``; a page without text has one row without a span, a file that fails one with its ``error``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_read, SPANS)


def inspect(spans: DataFrame) -> DataFrame:
    """``n_pages`` of each file, with its error."""
    return spans.groupBy("path").agg(F.count_distinct("page_index").alias("n_pages"), F.max("error").alias("error"))
