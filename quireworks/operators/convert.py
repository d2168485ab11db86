"""Documents to books and raster documents: the stages of a conversion as one DataFrame plan.

Stages: spans of the files, repeated running text taken out, lines joined to
paragraphs, headings by font size, run-in and positioned headings promoted, the
text flag and warnings, then one package per document.  A document that fails
is a row with its error; it never fails the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geometry import f
from ..sources import archive, pdf
from . import markup as M
from . import pages as P
from . import sequences as Q
from .spans import KEYS

NO_TEXT_NOTE = "<p><em>This page has no reliable text layer.</em></p>"


def with_ids(spans: DataFrame) -> DataFrame:
    """Spans of files with a numeric ``doc_id`` (a hash of the path) and page bounds from the media box."""
    box = {"px": "least(media_x0, media_x1)", "py": "least(media_y0, media_y1)", "pw": "abs(media_x1 - media_x0)", "ph": "abs(media_y1 - media_y0)"}
    out = spans.withColumn("doc_id", F.xxhash64("path"))
    for name, expression in box.items():
        out = out.withColumn(name, f(F.expr(expression)))
    return out


def without_running_text(spans: DataFrame) -> DataFrame:
    """Spans without headers and footers that repeat over their document."""
    marks = P.repeated_running_text(spans).select("doc_id", F.col("zone"), F.col("text").alias("norm"))
    top = f("py") + f("ph")
    zone = F.when(f("y") > top * f(0.85), "header").when(f("y") + f("height") < top * f(0.15), "footer")
    return spans.withColumn("zone", zone).withColumn("norm", T.running_text(F.col("text"))).join(marks, ["doc_id", "zone", "norm"], "left_anti").drop("zone", "norm")


def _page_html(p: Q.PageSpans) -> Iterator[tuple]:
    """Paragraphs of a page: lines top to bottom and left column first; larger fonts are headings."""
    body = p.body()
    rows = Q.components(p, body)
    two = p.two_columns()
    def place(part: list[int]) -> tuple[float, float, float]:
        x, y, w, _ = Q.union(p.box[part])
        return (float(two and x + w / 2 >= p.middle), -float(y), float(x))
    out, held, last = [], [], None
    def flush() -> None:
        if held:
            out.append(f"<p>{M.escape(Q.squeeze(' '.join(held)))}</p>")
            held.clear()
    for part in sorted(rows, key=place):
        text = Q.squeeze(" ".join(p.text[i] for i in part))
        box, size = Q.union(p.box[part]), p.size[part].max()
        if size >= body * 1.3 and len(text) <= 160 and any(map(str.isalnum, text)):
            flush()
            out.append(f"<h{1 if size >= body * 1.6 else 2}>{M.escape(text)}</h{1 if size >= body * 1.6 else 2}>")
            last = None
            continue
        if last is not None and not 0 <= last - box[1] <= body * 1.8:
            flush()
        held.append(text)
        last = box[1]
    flush()
    yield M.promote_positioned_headings("\n".join(out), list(dict.fromkeys(Q.run_in_headings(p)))),


def semantic_pages(spans: DataFrame) -> DataFrame:
    """``doc_id, number, title, html, has_text`` of spans with ids; pages without text carry a note."""
    pages = spans.select(*KEYS).distinct()
    html = Q.per_page(without_running_text(spans.filter("text is not null")), _page_html, "html string")
    out = pages.join(html, KEYS, "left").withColumn("html", T.keep_xml(F.coalesce("html", F.lit(""))))
    out = out.withColumn("has_text", T.has_text(F.col("html")))
    out = out.withColumn("html", F.when(F.col("has_text"), F.col("html")).otherwise(F.concat("html", F.lit(NO_TEXT_NOTE))))
    number = (F.col("page_index") + 1).cast("int")
    title = F.coalesce(T.first_heading(F.col("html")), F.concat(F.lit("Page "), number.cast("string")))
    return out.select("doc_id", number.alias("number"), title.alias("title"), "html", "has_text")


def convert_books(spark: SparkSession, path: str, title: str | None = None, language: str = "en") -> DataFrame:
    """One EPUB per PDF file under ``path``: ``path, content, source_pages, text_pages, n_warnings, error``."""
    spans = pdf.read_spans(spark, path)
    good = with_ids(spans.filter("error is null"))
    pages = semantic_pages(good)
    books = archive.package_books(pages, title or T.DEFAULT_TITLE, language)
    warned = P.page_warnings(pages, ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_warnings"))
    names = spans.groupBy("path").agg(F.max("error").alias("failed")).withColumn("doc_id", F.xxhash64("path"))
    out = names.join(books, "doc_id", "left").join(warned, "doc_id", "left")
    return out.select("path", "content", "source_pages", "text_pages", F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"), F.coalesce("failed", "error").alias("error"))


def page_rasters(spark: SparkSession, path: str) -> DataFrame:
    """Rasters of PDF files whose pages are pictures: ``doc_id, page_index, width, height, pixels``."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "page_index", "width", "height", "pixels"]
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    document = pdf.Document(bytes(content))
                    rows += [(name, i, *found) for i, (n, _) in enumerate(document.pages) if (found := document.picture(n))]
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = files.mapInPandas(read, "path string, page_index long, width int, height int, pixels binary")
    return out.select(F.xxhash64("path").alias("doc_id"), "page_index", "width", "height", "pixels")
