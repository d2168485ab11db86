"""Operators over positioned text spans: page statistics, predicates and joins by place.

A span has the page keys, ``span_index, text, x, y, width, height, font_name,
font_size, font_weight`` and may have ``is_italic, is_monospace, heading_level,
artifact_type, rotation_degrees``; missing columns take their neutral value.
Pages have the keys and ``px, py, pw, ph`` (bounds).  Joins by place are
equi-joins on the page keys with the geometry as a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.geometry import Rect, bounding_box, centre_inside, expand, f, intersection, overlap_fraction, vertical_gap

KEYS = ["doc_id", "page_index"]
NEUTRAL = {"is_italic": "false", "is_monospace": "false", "heading_level": "cast(null as int)", "artifact_type": "cast(null as string)", "rotation_degrees": "cast(0 as float)"}
PAGE = {"px": 0.0, "py": 0.0, "pw": 612.0, "ph": 792.0}
LEAST_OVERLAP = 0.25


def complete(spans: DataFrame) -> DataFrame:
    """Spans with every optional column and page bounds."""
    for name, value in NEUTRAL.items():
        if name not in spans.columns:
            spans = spans.withColumn(name, F.expr(value))
    for name, value in PAGE.items():
        if name not in spans.columns:
            spans = spans.withColumn(name, f(value))
    return spans


def page_rect() -> Rect:
    return Rect(f("px"), f("py"), f("pw"), f("ph"))


def plain() -> Column:
    """Spans that are content: no artifact, not rotated."""
    return F.col("artifact_type").isNull() & (F.abs("rotation_degrees") < 1)


def blank(text: str = "text") -> Column:
    return F.regexp_replace(text, T.SPACE, "") == ""


def body_font_sizes(spans: DataFrame) -> DataFrame:
    """``body``: upper median of font sizes from 5 to 24 of spans with letters and no heading level; 10 without any."""
    spans = complete(spans)
    use = F.col("heading_level").isNull() & F.col("font_size").between(5, 24) & (T.letters(F.col("text")) > 0)
    counts = spans.groupBy(*KEYS, F.when(use, F.col("font_size")).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*KEYS).orderBy("size")
    some = counts.filter("size is not null").withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*KEYS)))
    found = some.filter("upto > all div 2").groupBy(*KEYS).agg(F.min("size").alias("body"))
    return spans.select(*KEYS).distinct().join(found, KEYS, "left").withColumn("body", F.coalesce("body", f(10)))


def two_column_pages(spans: DataFrame) -> DataFrame:
    """``n_left, n_right, n_crossing, two_columns`` over wide spans of 20 letters or more."""
    spans = complete(spans)
    r, page = Rect.of(), page_rect()
    wide = (r.w >= page.w * f(0.2)) & (T.letters(F.col("text")) >= 20)
    left, right = r.right < page.cx - f(5), r.x > page.cx + f(5)
    out = spans.groupBy(*KEYS).agg(
        F.count_if(wide & left).alias("n_left"), F.count_if(wide & ~left & right).alias("n_right"), F.count_if(wide & ~left & ~right).alias("n_crossing"))
    return out.withColumn("two_columns", (F.col("n_left") >= 4) & (F.col("n_right") >= 4) & (F.col("n_crossing") <= 2))


def solid(text: str = "text") -> Column:
    """Characters other than white space."""
    return F.length(F.regexp_replace(text, T.SPACE, ""))


def math_density(spans: DataFrame, least_spans: int = 100, least_chars: int = 100) -> DataFrame:
    """``n_content, n_math, math_chars, math_dense`` of pages; excluded regions are taken out before."""
    spans = complete(spans).filter(plain() & ~blank())
    math = T.is_math_span(F.col("font_name"), F.col("text"))
    out = spans.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_content"), F.count_if(math).alias("n_math"), F.coalesce(F.sum(F.when(math, solid())), F.lit(0)).alias("math_chars"))
    return out.withColumn("math_dense", (F.col("n_math") >= least_spans) & (F.col("math_chars") >= least_chars) & (3 * F.col("n_math") >= F.col("n_content")))


def unreliable_math(spans: DataFrame, extracted: DataFrame) -> DataFrame:
    """``unreliable``: whether ``extracted`` (keys, html) lost the pages' mathematics or spans are fragments of it."""
    spans = complete(spans).filter(plain()).join(body_font_sizes(spans), KEYS)
    math, syntax = T.is_math_span(F.col("font_name"), F.col("text")), T.math_syntax_count(F.col("text"))
    total = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
    page = spans.groupBy(*KEYS).agg(
        total(math, syntax).alias("source"), total(~math, syntax).alias("beside"), F.count_if(math & (solid() <= 2)).alias("fragments"),
        F.count_if(math & (F.col("font_size") <= F.col("body") * f(0.82))).alias("scripts"))
    page = page.join(extracted.select(*KEYS, T.math_syntax_count(T.strip_markup(F.col("html"))).alias("extracted")), KEYS)
    kept = F.greatest(F.col("extracted") - F.col("beside"), F.lit(0))
    lost = (F.col("source") >= 6) & (2 * kept < F.col("source"))
    return page.withColumn("unreliable", lost | ((F.col("fragments") >= 100) & (F.col("scripts") >= 12)))


def _body_like() -> Column:
    return plain() & (T.letters(F.col("text")) > 0) & (F.col("font_size") >= F.col("body") * f(0.8)) & (F.col("font_size") <= F.col("body") * f(1.3))


def dominant_fonts(spans: DataFrame) -> DataFrame:
    """``font_name, letters``: the font with most letters in body-like spans; ties go to the larger name."""
    spans = complete(spans).join(body_font_sizes(spans), KEYS).filter(_body_like())
    per = spans.groupBy(*KEYS, "font_name").agg(F.sum(T.letters(F.col("text"))).alias("letters"))
    return per.groupBy(*KEYS).agg(F.max(F.struct("letters", "font_name")).alias("m")).select(*KEYS, "m.font_name", "m.letters")


def column_starts(spans: DataFrame) -> DataFrame:
    """``left_x, right_x``: smallest x of body-like spans left and right of the page's middle."""
    spans = complete(spans).join(body_font_sizes(spans), KEYS).filter(_body_like())
    left = f("x") < page_rect().cx
    return spans.groupBy(*KEYS).agg(F.min(F.when(left, F.col("x"))).alias("left_x"), F.min(F.when(~left, F.col("x"))).alias("right_x"))


def title_spans(spans: DataFrame) -> DataFrame:
    """Spans that lie in the title area, with the page's largest font there; ``is_title`` if theirs comes near it."""
    spans = complete(spans)
    r, page = Rect.of(), page_rect()
    inside = (
        plain() & (F.col("font_size") > 0) & (r.w >= 0) & (r.w <= page.w) & (r.h > 0) & (r.h <= page.h * f(0.2)) & (r.x >= page.x - f(1)) & (r.right <= page.right + f(1))
        & (r.y >= page.y - f(1)) & (r.top <= page.top + f(1)) & (r.top >= page.y + page.h * f(0.6)) & (F.length("text") > 0))
    spans = spans.filter(inside)
    sized = F.when(F.col("text").rlike(r"[\p{L}\p{N}]"), F.col("font_size"))
    largest = spans.groupBy(*KEYS).agg(F.max(sized).alias("largest"))
    return spans.join(largest, KEYS).withColumn("is_title", F.col("font_size") >= F.greatest(F.col("largest") * f(0.88), f(11)))


def place_join(left: DataFrame, right: DataFrame, region: Rect, subject: Rect, least: float = LEAST_OVERLAP) -> Column:
    return overlap_fraction(subject, region) >= f(least)


def _as_regions(regions: DataFrame) -> DataFrame:
    """Regions (keys, x, y, width, height) renamed so that they do not clash with spans."""
    return regions.select(*[F.col(k).alias(f"_{k}") for k in KEYS], *[f(c).alias(f"_r{c}") for c in ("x", "y", "width", "height")])


def _same_page() -> Column:
    condition = F.lit(True)
    for k in KEYS:
        condition = condition & (F.col(k) == F.col(f"_{k}"))
    return condition


def outside_regions(spans: DataFrame, regions: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """Spans of which no region covers the share ``least``."""
    region = Rect.of("_r")
    return spans.join(_as_regions(regions), _same_page() & (overlap_fraction(Rect.of(), region) >= f(least)), "left_anti")


def inside_regions(spans: DataFrame, regions: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    region = Rect.of("_r")
    return spans.join(_as_regions(regions), _same_page() & (overlap_fraction(Rect.of(), region) >= f(least)), "left_semi")


def overlaps(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """Each span's largest overlap fraction with a region of its page; 0 without regions."""
    both = spans.join(_as_regions(regions), _same_page(), "left")
    share = F.coalesce(F.max(overlap_fraction(Rect.of(), Rect.of("_r"))), f(0))
    return both.groupBy(*KEYS, "span_index").agg(share.alias("overlap"))


def tighten_regions(coarse: DataFrame, graphics: DataFrame) -> DataFrame:
    """Coarse regions (keys, region_index, rect) shrunk to the local graphics whose centre they hold.

    Graphics count if at most 1.2 times the region each way; their union must be
    24 by 24, and two points are added around it within the region.
    """
    both = coarse.join(_as_regions(graphics), _same_page())
    c, g = Rect.of(), Rect.of("_r")
    cut, some = intersection(g, c)
    local = (g.w <= c.w * f(1.2)) & (g.h <= c.h * f(1.2)) & centre_inside(g, c) & some
    both = both.filter(local).select(*KEYS, "region_index", *[f(n).alias(f"c{n}") for n in ("x", "y", "width", "height")], cut.x.alias("gx"), cut.y.alias("gy"), cut.w.alias("gw"), cut.h.alias("gh"))
    box = both.groupBy(*KEYS, "region_index", "cx", "cy", "cwidth", "cheight").agg(*bounding_box(Rect(f("gx"), f("gy"), f("gw"), f("gh"))))
    box = box.filter("width >= 24 and height >= 24")
    out, some = intersection(expand(Rect.of(), 2), Rect.of("c"))
    return box.filter(some).select(*KEYS, "region_index", out.x.alias("x"), out.y.alias("y"), out.w.alias("width"), out.h.alias("height"))


def next_captions(captions: DataFrame, height: float = 225.0, margin: float = 20.0) -> DataFrame:
    """Crop ranges of captions (keys, caption_index, rect, column): ``crop_bottom, crop_top``.

    The first other caption, by index, that lies higher in the same column (or
    either is of full width) ends the crop eight points below itself.
    """
    captions = complete(captions)
    bottom = f("y") + f("height") + f(2)
    one = captions.withColumn("crop_bottom", bottom).withColumn("limit", F.least(bottom + f(height), f("py") + f("ph") - f(margin)))
    other = captions.select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.col("caption_index").alias("_i"), f("y").alias("_y"), F.col("column").alias("_column"))
    near = (F.col("_y") > f("y")) & ((F.col("_column") == F.col("column")) | (F.col("_column") == "Full") | (F.col("column") == "Full"))
    both = one.join(other, _same_page() & near, "left").groupBy(*KEYS, "caption_index", "crop_bottom", "limit").agg(F.min(F.struct("_i", "_y")).alias("next"))
    top = F.least("limit", F.coalesce(F.col("next._y") - f(8), F.col("limit")))
    return both.select(*KEYS, "caption_index", "crop_bottom", top.alias("crop_top")).withColumn("usable", F.col("crop_top") - F.col("crop_bottom") >= f(24))


def numbered_equations(spans: DataFrame) -> DataFrame:
    """``span_index, anchor, n_spans, x, y, width, height``: equations that a number at their column's right names.

    A span belongs to the number that is nearest vertically among the column's
    right-aligned ones; ties belong to all of them.
    """
    spans = complete(spans)
    info = body_font_sizes(spans).join(two_column_pages(spans).select(*KEYS, "two_columns"), KEYS)
    spans = spans.join(info, KEYS)
    r, page = Rect.of(), page_rect()
    numbers = spans.filter(T.is_equation_number(F.col("text")))
    left_half = r.cx < page.cx
    low = F.when(F.col("two_columns") & ~left_half, page.cx).otherwise(page.x)
    high = F.when(F.col("two_columns") & left_half, page.cx).otherwise(page.right)
    numbers = numbers.select(
        *[F.col(k).alias(f"_{k}") for k in KEYS], F.col("span_index").alias("_i"), T.collapse(F.col("text")).alias("anchor"), r.x.alias("_rx"), r.y.alias("_ry"), r.w.alias("_rwidth"), r.h.alias("_rheight"),
        low.alias("low"), high.alias("high"), r.cx.alias("_cx"), r.cy.alias("_cy")).filter(F.col("_cx") >= F.col("low") + (F.col("high") - F.col("low")) * f(0.78))
    both = spans.join(numbers, _same_page())
    distance = F.abs(r.cy - F.col("_cy"))
    near = (F.col("span_index") != F.col("_i")) & (r.cx >= F.col("low")) & (r.cx < F.col("_rx") - F.col("body") * f(0.4))
    both = both.withColumn("distance", distance).filter(F.col("span_index") != F.col("_i"))
    # the nearest right-aligned number of the column, whoever asks
    nearest = F.min("distance").over(Window.partitionBy(*KEYS, "span_index", "low", "high"))
    both = both.withColumn("nearest", nearest).filter(near & (F.col("distance") <= F.col("body") * f(1.6)) & (F.col("distance") <= F.col("nearest")))
    math, font = T.is_math_span(F.col("font_name"), F.col("text")), F.col("font_name")
    found = both.groupBy(*KEYS, "_i", "anchor", "_rx", "_ry", "_rwidth", "_rheight", "body").agg(
        F.count(F.lit(1)).alias("n_spans"), F.bool_or(T.is_mixed_prose(font, F.col("text"))).alias("prose"), F.bool_or(math).alias("math"),
        F.bool_or(T.has_relation(F.col("text"))).alias("relation"), *bounding_box(r))
    found = found.filter((F.col("n_spans") >= 2) & ~F.col("prose") & F.col("math") & F.col("relation") & (F.col("width") >= F.col("body") * f(4)) & (F.col("height") >= F.col("body") * f(0.7)))
    return found.select(*KEYS, F.col("_i").alias("span_index"), "anchor", "n_spans", "x", "y", "width", "height")


def isolation(boxes: DataFrame, spans: DataFrame) -> DataFrame:
    """Boxes (keys, box_index, rect, span_index of their member, low, high, body) with ``isolated``: no other span of the column within 0.75 lines."""
    s = spans.select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.col("span_index").alias("_i"), *[f(c).alias(f"_r{c}") for c in ("x", "y", "width", "height")])
    b, o = Rect.of(), Rect.of("_r")
    beside = (F.least(b.right, o.right) - F.greatest(b.x, o.x) > 0) & o.cx.between(F.col("low"), F.col("high"))
    close = beside & (F.col("_i") != F.col("span_index")) & (vertical_gap(b, o) < F.col("body") * f(0.75))
    crowded = boxes.join(s, _same_page() & close, "left_semi").select(*KEYS, "box_index").withColumn("isolated", F.lit(False))
    return boxes.join(crowded, [*KEYS, "box_index"], "left").withColumn("isolated", F.coalesce("isolated", F.lit(True)))


def row_components(spans: DataFrame) -> DataFrame:
    """``component`` numbers of spans within rows of equal y: cut where the gap exceeds 2.5 lines."""
    spans = complete(spans).filter(plain() & ~blank()).join(body_font_sizes(spans), KEYS)
    row = Window.partitionBy(*KEYS, "y").orderBy("x", "span_index")
    reach = F.max(f("x") + f("width")).over(row.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("cut", F.coalesce((f("x") - reach > F.col("body") * f(2.5)).cast("int"), F.lit(0)))
    spans = spans.withColumn("component", F.sum("cut").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return spans


def component_boxes(spans: DataFrame) -> DataFrame:
    """Row components as ``y, component, n_spans, x, width``."""
    return row_components(spans).groupBy(*KEYS, "y", "component").agg(
        F.count(F.lit(1)).alias("n_spans"), F.min("x").alias("x"), (F.max(f("x") + f("width")) - F.min("x")).alias("width"))


def formula_components(spans: DataFrame) -> DataFrame:
    """Row components that look like display formulas: margins, a relation sign, few words and a fifth of the characters mathematical."""
    spans = complete(spans)
    rows = row_components(spans).join(two_column_pages(spans).select(*KEYS, "two_columns"), KEYS)
    text, math = F.col("text"), T.is_math_span(F.col("font_name"), F.col("text"))
    real = F.size(F.filter(F.transform(T.words(text), T.letters), lambda n: n >= 2))
    box = rows.groupBy(*KEYS, "y", "component", "body", "two_columns", "px", "pw").agg(
        F.bool_or(F.col("heading_level").isNotNull() | F.col("is_monospace") | T.is_veto_label(text)).alias("veto"), F.sum(solid()).alias("chars"),
        F.sum(F.when(math, solid()).otherwise(0)).alias("math_chars"), F.sum(F.when(~math, real).otherwise(0)).alias("n_words"), F.bool_or(T.has_relation(text)).alias("relation"),
        F.min("x").alias("x"), (F.max(f("x") + f("width")) - F.min("x")).alias("width"))
    middle, cx = f("px") + f("pw") * f(0.5), f("x") + f("width") * f(0.5)
    left = cx < middle
    low = F.when(F.col("two_columns") & ~left, middle).otherwise(f("px"))
    high = F.when(F.col("two_columns") & left, middle).otherwise(f("px") + f("pw"))
    span = high - low
    fits = (f("width") >= F.col("body") * f(4)) & (f("width") <= span * f(0.78)) & (f("x") - low >= span * f(0.1)) & (high - f("x") - f("width") >= span * f(0.1))
    good = fits & ~F.col("veto") & F.col("relation") & (F.col("n_words") <= 8) & (F.col("chars") >= 6) & (F.col("math_chars") * 5 >= F.col("chars"))
    return box.filter(good).select(*KEYS, "y", "component", "x", "width", "chars", "math_chars", "n_words")


def figure_captions(lines: DataFrame) -> DataFrame:
    """Captions of ``lines`` (keys, line_index, words array<struct<text,x,y,width,height>>): the first "figure n:" of each line with four words or more.

    ``column`` is Full near the page's middle or when wide, else Left or Right.
    """
    lines = complete(lines)
    words = lines.select(*KEYS, "line_index", "px", "pw", "words", F.posexplode("words").alias("i", "w"))
    following = F.try_element_at(F.col("words"), (F.col("i") + 2).cast("int"))["text"]
    number = F.regexp_extract(T.collapse(following), r"^\+?0*([0-9]{1,5}):+$", 1)
    named = F.lower(F.regexp_replace(F.col("w.text"), r"^\P{L}+|\P{L}+$", "")) == "figure"
    words = words.filter(named & (F.expr("try_cast(nullif('', '') as int)").isNull()) & (number != "") & (number.try_cast("int") <= 65535) & (F.size("words") - F.col("i") >= 4))
    first = F.row_number().over(Window.partitionBy(*KEYS, "line_index").orderBy("i"))
    words = words.withColumn("rank", first).filter("rank = 1").select(*KEYS, "line_index", "px", "pw", F.expr("slice(words, i + 1, size(words))").alias("ws"))
    least = lambda g: F.array_min(F.transform("ws", g))
    most = lambda g: F.array_max(F.transform("ws", g))
    out = words.select(
        *KEYS, "line_index", "px", "pw", least(lambda w: w["x"]).alias("x"), least(lambda w: w["y"]).alias("y"),
        (most(lambda w: f(w["x"]) + f(w["width"])) - least(lambda w: w["x"])).alias("width"), (most(lambda w: f(w["y"]) + f(w["height"])) - least(lambda w: w["y"])).alias("height"),
        F.array_join(F.transform("ws", lambda w: T.collapse(w["text"])), " ").alias("text"))
    centre, middle = f("x") + f("width") * f(0.5), f("px") + f("pw") * f(0.5)
    full = (F.abs(centre - middle) < f("pw") * f(0.12)) | (f("width") > f("pw") * f(0.48))
    column = F.when(full, "Full").when(centre < middle, "Left").otherwise("Right")
    index = F.row_number().over(Window.partitionBy(*KEYS).orderBy("line_index")) - 1
    return out.withColumn("column", column).withColumn("caption_index", index).drop("px", "pw")


def anchor_tokens(spans: DataFrame, most: int = 8) -> DataFrame:
    """Tokens (letters and digits, upper case) with at most ``most`` spans of a page, and those spans."""
    spans = spans.withColumn("token", T.heading_token(F.col("text"))).filter("token <> ''")
    counts = spans.groupBy(*KEYS, "token").agg(F.count(F.lit(1)).alias("n_anchors"), F.min("span_index").alias("first_span"))
    return counts.filter(F.col("n_anchors") <= most)


def table_row_headings(spans: DataFrame, headings: DataFrame) -> DataFrame:
    """Headings (keys, heading_index, text) that are a window of words in a table row of the same style."""
    spans = complete(spans).join(body_font_sizes(spans), KEYS)
    wanted = F.filter(F.transform(T.words(F.col("text")), T.heading_token), lambda w: w != "")
    heads = headings.select(*[F.col(k).alias(f"_{k}") for k in KEYS], "heading_index", wanted.alias("wanted")).filter("size(wanted) >= 2")
    anchors = spans.withColumn("token", T.heading_token(F.col("text")))
    anchors = anchors.join(heads, _same_page() & (F.col("token") == F.col("wanted")[0]))
    few = F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "heading_index"))
    anchors = anchors.withColumn("few", few).filter("few <= 8").filter(plain() & (F.col("font_weight") >= 500) & (F.col("font_size") >= F.col("body") * f(0.8)) & (F.col("font_size") <= F.col("body") * f(1.15)))
    middle = page_rect().cx
    left = Rect.of().cx < middle
    anchors = anchors.select(
        *[F.col(k).alias(f"_{k}") for k in KEYS], "heading_index", "wanted", F.col("span_index").alias("a"), F.col("font_name").alias("a_font"), F.col("font_weight").alias("a_weight"),
        F.col("is_italic").alias("a_italic"), F.col("font_size").alias("a_size"), f("y").alias("a_y"), F.when(left, f("px")).otherwise(middle).alias("low"), F.when(left, middle).otherwise(f("px") + f("pw")).alias("high"))
    same = (
        plain() & (F.col("font_name") == F.col("a_font")) & ((F.col("font_weight") == F.col("a_weight")) | blank()) & (F.col("is_italic") == F.col("a_italic"))
        & (F.abs(F.col("font_size") - F.col("a_size")) <= F.col("body") * f(0.05)) & (F.abs(f("y") - F.col("a_y")) <= F.col("body") * f(0.2)) & (f("x") >= F.col("low")) & (f("x") + f("width") <= F.col("high")))
    row = spans.join(anchors, _same_page() & same).groupBy(*KEYS, "heading_index", "a", "wanted").agg(F.array_sort(F.collect_list(F.struct("x", "span_index", "text"))).alias("row"))
    row = row.filter("size(row) <= 64")
    found = F.filter(F.transform(F.flatten(F.transform("row", lambda s: T.words(s["text"]))), T.heading_token), lambda w: w != "")
    row = row.withColumn("found", found).withColumn("n", F.size("wanted"))
    at = F.expr("filter(sequence(0, greatest(size(found) - n, 0)), i -> slice(found, i + 1, n) = wanted)")
    row = row.withColumn("at", F.try_element_at(at, F.lit(1))).filter("at is not null")
    others = F.expr("concat(slice(found, 1, at), slice(found, at + n + 1, size(found)))")
    row = row.filter(F.exists(others, lambda w: T.letters(w) >= 3))
    return row.select(*KEYS, "heading_index").distinct()
