"""Operators over whole pages and documents: running text, reports, budgets, previews, warnings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.geometry import Rect, f, overlap_fraction
from .spans import complete

MIB = 1024 * 1024


def text_report(pages: DataFrame, markup: str = "html", key: str = "page_id") -> DataFrame:
    """``title, visible_len, has_text, heading_count`` of each page's markup."""
    m = F.col(markup)
    out = pages.select(key, T.strip_markup(m).alias("t"), T.headings(m).alias("h"))
    length = F.length(F.replace("t", F.lit(" "), F.lit("")))
    title = F.coalesce(F.try_element_at("h", F.lit(1))["text"], F.concat(F.lit("Page "), F.col(key).cast("string")))
    return out.select(key, title.alias("title"), length.alias("visible_len"), (length >= 20).alias("has_text"), F.size("h").alias("heading_count"))


def repeated_running_text(spans: DataFrame, least_share: float = 0.6) -> DataFrame:
    """``doc_id, zone, text, n_pages``: text that repeats at the top or bottom of enough pages.

    Documents of under three pages have none.  Digits do not count.  Enough is
    ``least_share`` of the pages (in single precision, rounded up) and two.
    """
    spans = complete(spans)
    pages = spans.groupBy("doc_id").agg(F.count_distinct("page_index").alias("pages")).filter("pages >= 3")
    run = spans.withColumn("run", T.running_text(F.col("text"))).filter(F.octet_length("run") > 3)
    top = f("py") + f("ph")
    zone = F.array_compact(F.array(F.when(f("y") > top * f(0.85), "header"), F.when(f("y") + f("height") < top * f(0.15), "footer")))
    zoned = run.select("doc_id", "page_index", F.col("run").alias("text"), F.explode(zone).alias("zone"))
    counts = zoned.groupBy("doc_id", "zone", "text").agg(F.count_distinct("page_index").alias("n_pages"))
    least = F.greatest(F.ceil((F.col("pages").cast("float") * f(least_share)).cast("float")), F.lit(2))
    return counts.join(pages, "doc_id").filter(F.col("n_pages") >= least).select("doc_id", "zone", "text", "n_pages")


def strip_running_blocks(blocks: DataFrame, repeated: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks (keys, block_no, markup, doc key in ``keys[0]``) without running headers and footers.

    Of a page's first two blocks, one of each repeated header goes; of its last
    two, one of each repeated footer (the last one).
    """
    page = Window.partitionBy(*keys)
    blocks = blocks.withColumn("norm", T.running_text(T.strip_markup(F.regexp_replace("markup", r"(?s)^<[^>]*>|</[^>]*>$", ""))))
    blocks = blocks.withColumn("from_start", F.row_number().over(page.orderBy("block_no"))).withColumn("from_end", F.row_number().over(page.orderBy(F.desc("block_no"))))
    marks = repeated.select(F.col(repeated.columns[0]).alias(keys[0]), F.col("zone"), F.col("text").alias("norm"))
    for zone, at in (("header", "from_start"), ("footer", "from_end")):
        edge = blocks.filter(F.col(at) <= 2).join(marks.filter(F.col("zone") == zone).drop("zone"), [keys[0], "norm"])
        gone = edge.groupBy(*keys, "norm").agg(F.min_by("block_no", at).alias("block_no")).select(*keys, "block_no")
        blocks = blocks.join(gone, [*keys, "block_no"], "left_anti")
    return blocks.drop("norm", "from_start", "from_end")


def trustworthy_prose(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``html, n_blocks``: the trustworthy prose blocks of each page, in order, one to a line."""
    good = blocks.filter(T.is_trustworthy_block(F.col("tag"), F.regexp_replace("markup", r"(?s)^<[^>]*>|</[^>]*>$", "")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "markup"))), lambda b: F.concat(b["markup"], F.lit("\n"))), "")
    return good.groupBy(*keys).agg(joined.alias("html"), F.count(F.lit(1)).alias("n_blocks"))


def running_budget(rows: DataFrame, keys: list[str], order: list[str], amount: Column, limit: int) -> DataFrame:
    """Rows with the running ``total`` and ``status``: 'ok', 'over' at the first row beyond the limit, 'after' behind it."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("total", F.sum(amount).over(upto))
    first = (F.col("total") > limit) & (F.col("total") - amount <= limit)
    return rows.withColumn("status", F.when(F.col("total") <= limit, "ok").when(first, "over").otherwise("after"))


@dataclass(frozen=True)
class PreviewLimits:
    max_chapters: int = 12
    max_xhtml_bytes: int = 2 * MIB
    max_asset_bytes: int = 8 * MIB
    max_assets: int = 48


def preview_prefix(pages: DataFrame, keys: list[str], limits: PreviewLimits = PreviewLimits()) -> DataFrame:  # noqa: B008
    """The leading pages (keys, number, html, title, xhtml_bytes, image_markup, asset_bytes, n_assets) a preview holds.

    A page ends the preview if its estimated or actual markup, its assets or
    their number would go beyond a limit; pages behind it are left out however
    small they are.
    """
    order = Window.partitionBy(*keys).orderBy("number")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    estimate = F.col("image_markup") + F.octet_length("html") + 6 * F.octet_length("title") + 1024
    used = F.coalesce(F.sum("xhtml_bytes").over(before), F.lit(0))
    over = (
        (F.row_number().over(order) > limits.max_chapters) | (used + estimate > limits.max_xhtml_bytes) | (used + F.col("xhtml_bytes") > limits.max_xhtml_bytes)
        | (F.sum("asset_bytes").over(upto) > limits.max_asset_bytes) | (F.sum("n_assets").over(upto) > limits.max_assets))
    out = pages.withColumn("stop", over.cast("int"))
    return out.withColumn("stop", F.max("stop").over(upto)).filter("stop = 0").drop("stop")


MIN_IMAGE_PIXELS, MAX_IMAGE_PIXELS, MAX_DECODE_PIXELS = 4096, 4_000_000, 32_000_000


def image_recovery(images: DataFrame) -> DataFrame:
    """``action`` (keep, downsample, skip), ``out_width, out_height, visual_page`` of images (width, height, bx, by_, bw, bh, image_only).

    Images above four million pixels are kept only as the sole content of a page
    they cover by three quarters, and are then scaled down.
    """
    images = complete(images)
    pixels = F.col("width").cast("long") * F.col("height")
    page = Rect(f("px"), f("py"), f("pw"), f("ph"))
    visual = F.col("image_only") & (overlap_fraction(page, Rect(f("bx"), f("by_"), f("bw"), f("bh"))) >= f(0.75))
    fits = pixels.between(MIN_IMAGE_PIXELS, MAX_DECODE_PIXELS)
    large = pixels > MAX_IMAGE_PIXELS
    action = F.when(~fits | (large & ~visual), "skip").when(large, "downsample").otherwise("keep")
    scale = F.sqrt(F.lit(float(MAX_IMAGE_PIXELS)) / pixels)
    w = F.greatest(F.floor(F.col("width") * scale), F.lit(1))
    h = F.greatest(F.floor(F.col("height") * scale), F.lit(1))
    h = F.least(h, F.floor(F.lit(MAX_IMAGE_PIXELS) / w))
    out = images.withColumn("visual_page", visual).withColumn("action", action)
    size = lambda c, s: F.when(F.col("action") == "skip", None).when(F.col("action") == "downsample", s).otherwise(F.col(c)).cast("long")
    return out.withColumn("out_width", size("width", w)).withColumn("out_height", size("height", h)).drop("px", "py", "pw", "ph", "is_italic", "is_monospace", "heading_level", "artifact_type", "rotation_degrees")


def image_budget(images: DataFrame, per_page: int = 64_000_000, total: int = 512_000_000) -> DataFrame:
    """Decoded pixels of kept images with the page's and the document's running totals and the budget that fails first."""
    kept = images.filter("action <> 'skip'").withColumn("pixels", F.col("width").cast("long") * F.col("height"))
    page = Window.partitionBy("doc_id", "page_index").orderBy("image_index").rowsBetween(Window.unboundedPreceding, 0)
    doc = Window.partitionBy("doc_id").orderBy("page_index", "image_index").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("page_total", F.sum("pixels").over(page)).withColumn("doc_total", F.sum("pixels").over(doc))
    return kept.withColumn("failed", F.when(F.col("page_total") > per_page, "page").when(F.col("doc_total") > total, "document"))


#: The groups of warnings, in the order in which they are tried.
WARNING_GROUPS = [
    ("Text recovery", r"\b(ocr|text layer|selectable text|text extraction)\b"),
    ("Browser limits", r"\b(limit|budget|exceed|too large|memory|skipped)\b"),
    ("Visual content", r"\b(math|equations?|figures?|images?|visual|columns?)\b"),
    ("Processing", r"\b(could not|failed|decode|encode|inspect)\b"),
]
OTHER_WARNINGS = "Other conversion notes"


def warning_group(text: Column) -> Column:
    out = F.lit(OTHER_WARNINGS)
    for name, pattern in reversed(WARNING_GROUPS):
        out = F.when(text.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def clean_warning(text: Column) -> Column:
    """Trimmed; texts above 800 characters are cut and marked; blank ones are null."""
    text = F.regexp_replace(text, f"^{T.SPACE}+|{T.SPACE}+$", "")
    return F.when(text == "", None).when(F.length(text) > 800, F.concat(F.substring(text, 1, 797), F.lit("…"))).otherwise(text)


def warning_groups(warnings: DataFrame, keys: list[str]) -> DataFrame:
    """``group, n, first_seq``: warnings (keys, seq, text) by group; first_seq orders the groups."""
    cleaned = warnings.withColumn("text", clean_warning(F.col("text"))).filter("text is not null")
    return cleaned.groupBy(*keys, warning_group(F.col("text")).alias("group")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def page_warnings(pages: DataFrame, keys: list[str]) -> DataFrame:
    """``seq, text`` of pages (keys, number, has_text) without a reliable text layer, and of documents without any text."""
    missing = pages.filter(~F.col("has_text")).select(
        *keys, F.col("number").cast("long").alias("seq"), F.concat(F.lit("Page "), F.col("number").cast("string"), F.lit(" has no reliable text layer.")).alias("text"))
    none = pages.groupBy(*keys).agg(F.bool_or("has_text").alias("some")).filter(~F.col("some"))
    return missing.unionByName(none.select(*keys, F.lit(2**31).cast("long").alias("seq"), F.lit("The document has no selectable text.").alias("text")))


def document_report(pages: DataFrame, keys: list[str]) -> DataFrame:
    """``source_pages, text_pages, image_count, n_warnings`` of pages (keys, number, has_text, n_images)."""
    counts = pages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("source_pages"), F.count_if("has_text").alias("text_pages"), F.sum("n_images").alias("image_count"))
    warned = page_warnings(pages, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(warned, keys, "left").withColumn("n_warnings", F.coalesce("n", F.lit(0))).drop("n")


def validate_files(files: DataFrame, most: int = 64 * MIB) -> DataFrame:
    """``problem`` of files (name, mime, size): null if it can be converted."""
    pdf = (F.col("mime") == "application/pdf") | F.lower("name").endswith(".pdf")
    problem = F.when(~F.coalesce(pdf, F.lit(False)), "not a PDF").when(F.coalesce("size", F.lit(0)) == 0, "empty").when(F.col("size") > most, "too large")
    return files.withColumn("problem", problem)


def reader_pages(scroll_width: Column, column_width: Column, gap: int = 48) -> Column:
    """Screens of a paginated chapter."""
    return F.greatest(F.floor((scroll_width + gap) / (column_width + gap) + 0.5), F.lit(1)).cast("long")


#: Device presets (width, height, dots per inch).
PRESETS = [(758, 1024, 167), (1072, 1448, 300), (1080, 1440, 265)]


def resolve_assets(chapters: DataFrame, assets: DataFrame) -> DataFrame:
    """Chapter images (chapter, src) with the asset (href) they name, if any; ``../`` and fragments are resolved."""
    href = F.regexp_replace(F.regexp_replace("src", r"[?#].*$", ""), r"^(\.\./)+", "")
    return chapters.withColumn("href", href).join(assets.withColumn("found", F.lit(True)), "href", "left").withColumn("found", F.coalesce("found", F.lit(False)))
