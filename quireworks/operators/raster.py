"""Raster operators over run-length encoded ink.

A raster is a relation of ink runs: page keys, ``y`` and columns ``x0`` to
``x1`` (``x1`` excluded); runs of a row do not touch.  ``ink_runs`` encodes
packed RGB pixels; everything after it is relational, so no pixel is a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["doc_id", "page_index"]


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(F.lit(54) * r.cast("int") + F.lit(183) * g.cast("int") + F.lit(19) * b.cast("int"), 8)


def decode_runs(width: int, height: int, pixels: bytes, threshold: int) -> np.ndarray:
    """Rows (y, x0, x1) of the runs darker than ``threshold`` in packed RGB pixels."""
    if len(pixels) != width * height * 3:
        raise ValueError("pixel bytes do not match the size")
    rgb = np.frombuffer(pixels, np.uint8).reshape(height, width, 3).astype(np.int32)
    ink = ((rgb @ np.array([54, 183, 19])) >> 8) < threshold
    edge = np.diff(np.pad(ink, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    y, x0 = np.nonzero(edge == 1)
    return np.stack([y, x0, np.nonzero(edge == -1)[1]], 1)


def ink_runs(rasters: DataFrame, threshold: int = 210) -> DataFrame:
    """Runs of ``rasters`` (keys, width, height, pixels)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                found = decode_runs(row.width, row.height, row.pixels, threshold)
                out = pd.DataFrame(found, columns=["y", "x0", "x1"]).astype("int64")
                yield out.assign(doc_id=row.doc_id, page_index=row.page_index)[[*KEYS, "y", "x0", "x1"]]

    return rasters.mapInPandas(run, "doc_id long, page_index long, y long, x0 long, x1 long")


def content_bounds(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Smallest rectangle around a page's ink; pages without ink have no row."""
    return runs.groupBy(*keys).agg(
        F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0")).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))


def ink_rows(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Maximal runs of inked rows with their horizontal extent: ``x, y, width, height``."""
    rows = runs.groupBy(*keys, "y").agg(F.min("x0").alias("a"), F.max("x1").alias("b"))
    island = F.col("y") - F.row_number().over(Window.partitionBy(*keys).orderBy("y"))
    rows = rows.withColumn("island", island).groupBy(*keys, "island")
    return rows.agg(
        F.min("a").alias("x"), F.min("y").alias("y"), (F.max("b") - F.min("a")).alias("width"), F.count(F.lit(1)).alias("height")).drop("island")


def vertical_regions(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Page bounds cut at blank bands of ``max(height div 100, 8)`` rows: ``region, x, y, width, height``."""
    bounds = content_bounds(runs, keys).select(*keys, F.col("x").alias("bx"), F.col("width").alias("bw"), F.greatest(F.expr("height div 100"), F.lit(8)).alias("band"))
    rows = runs.select(*keys, "y").distinct().join(bounds, keys)
    order = Window.partitionBy(*keys).orderBy("y")
    cut = F.coalesce((F.col("y") - F.lag("y").over(order) - 1 >= F.col("band")).cast("long"), F.lit(0))
    rows = rows.withColumn("cut", cut)
    rows = rows.withColumn("region", F.sum("cut").over(order))
    return rows.groupBy(*keys, "region").agg(
        F.min("bx").alias("x"), F.min("y").alias("y"), F.min("bw").alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))


def gutter_splits(runs: DataFrame, regions: DataFrame, keys: list[str] = KEYS, max_columns: int = 2) -> DataFrame:
    """Columns of each region: ``region, part, x, y, width, height``.

    A gutter is a run of pixel columns with ink in at most ``max(height div
    100, 1)`` rows, at least ``max(width div 50, 6)`` wide, whose middle leaves a
    quarter of the width on both sides; the widest wins, then the most central,
    then the rightmost.
    """
    names = [*keys, "region"]
    box = regions.select(*names, F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("width").alias("rw"), F.col("height").alias("rh"))
    wide = box.filter((F.lit(max_columns) >= 2) & (F.col("rw") >= 128) & (F.col("rh") >= 48))
    inside = runs.join(wide, keys).filter("y >= ry and y < ry + rh")
    # a sweep over the ends of the runs: +1 where ink starts, -1 where it stops, 0 at the region's edges
    ends = inside.select(*names, "rx", "rw", "rh", F.explode(F.array(
        F.struct((F.col("x0") - F.col("rx")).alias("at"), F.lit(1).alias("step")), F.struct((F.col("x1") - F.col("rx")).alias("at"), F.lit(-1).alias("step")))).alias("e"))
    edges = wide.select(*names, "rx", "rw", "rh", F.explode(F.array(F.lit(0).cast("long"), F.col("rw"))).alias("at")).withColumn("step", F.lit(0))
    steps = ends.select(*names, "rx", "rw", "rh", "e.at", "e.step").unionByName(edges).groupBy(*names, "rx", "rw", "rh", "at").agg(F.sum("step").alias("step"))
    order = Window.partitionBy(*names).orderBy("at")
    steps = steps.withColumn("ink", F.sum("step").over(order)).withColumn("to", F.lead("at").over(order)).filter("to is not null")
    steps = steps.withColumn("low", F.col("ink") <= F.greatest(F.expr("rh div 100"), F.lit(1)))
    steps = steps.withColumn("turn", (F.col("low") != F.coalesce(F.lag("low").over(order), F.lit(False))).cast("int"))
    steps = steps.withColumn("group", F.sum("turn").over(order)).filter("low")
    gaps = steps.groupBy(*names, "rw", "group").agg(F.min("at").alias("start"), (F.max("to") - F.min("at")).alias("gap"))
    gaps = gaps.withColumn("split", F.expr("start + gap div 2")).filter("gap >= greatest(rw div 50, 6) and split >= rw div 4 and rw - split >= rw div 4")
    best = F.row_number().over(Window.partitionBy(*names).orderBy(F.desc("gap"), F.abs(F.col("split") - F.expr("rw div 2")), F.desc("start")))
    chosen = gaps.withColumn("rank", best).filter("rank = 1").select(*names, "split")
    out = box.join(chosen, names, "left")
    whole = F.array(F.struct(F.lit(0).alias("part"), F.col("rx").alias("x"), F.col("rw").alias("width")))
    halves = F.array(
        F.struct(F.lit(0).alias("part"), F.col("rx").alias("x"), F.col("split").alias("width")),
        F.struct(F.lit(1).alias("part"), (F.col("rx") + F.col("split")).alias("x"), (F.col("rw") - F.col("split")).alias("width")))
    out = out.select(*names, "ry", "rh", F.explode(F.when(F.col("split").isNull(), whole).otherwise(halves)).alias("p"))
    return out.select(*names, "p.part", "p.x", F.col("ry").alias("y"), "p.width", F.col("rh").alias("height"))


def word_boxes(runs: DataFrame, rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Words of each ink row: runs whose gap is at most ``max(height div 5, 1)``, tightened vertically."""
    band = rows.select(*keys, F.col("y").alias("row_y"), F.col("height").alias("row_h"))
    # every inked y lies in exactly one row: rows start where runs of y do
    order = Window.partitionBy(*keys).orderBy("y", "is_run").rowsBetween(Window.unboundedPreceding, 0)
    marks = band.select(*keys, F.col("row_y").alias("y"), F.lit(0).alias("is_run"), F.lit(None).cast("long").alias("x0"), F.lit(None).cast("long").alias("x1"), "row_y", "row_h")
    both = marks.unionByName(runs.select(*keys, "y", F.lit(1).alias("is_run"), "x0", "x1", F.lit(None).cast("long").alias("row_y"), F.lit(None).cast("long").alias("row_h")))
    both = both.withColumn("row_y", F.last("row_y", True).over(order)).withColumn("row_h", F.last("row_h", True).over(order)).filter("is_run = 1")
    names = [*keys, "row_y"]
    along = Window.partitionBy(*names).orderBy("x0", "x1", "y")
    before = F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("x0") - before > F.greatest(F.expr("row_h div 5"), F.lit(1))).cast("int"), F.lit(0))
    both = both.withColumn("new", new)
    both = both.withColumn("word", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return both.groupBy(*names, "word").agg(
        F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0")).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))


def upper_median(values: Column) -> Column:
    """The upper median of a collected array; 0 if it is empty."""
    return F.coalesce(F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int")), F.lit(0))


def row_medians(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``median``: upper median of row heights.

    Heights are counted before they are sorted, so a page sends one row per height.
    """
    counts = rows.groupBy(*keys, "height").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("height")
    counts = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    return counts.filter("upto > all div 2").groupBy(*keys).agg(F.min("height").alias("median"))


def paragraph_breaks(rows: DataFrame, keys: list[str] = KEYS, source_dpi: int = 150) -> DataFrame:
    """Rows with ``starts_paragraph`` (gap over the median, or indented over twice it) and ``is_block`` (too high for text)."""
    order = Window.partitionBy(*keys).orderBy("y", "x")
    rows = rows.join(row_medians(rows, keys), keys)
    gap = F.greatest(F.col("y") - F.lag(F.col("y") + F.col("height")).over(order), F.lit(0))
    shift = F.abs(F.col("x") - F.lag("x").over(order))
    starts = F.coalesce((gap > F.col("median")) | (shift > 2 * F.col("median")), F.lit(False))
    block = (F.col("height") > F.expr("5 * median div 2")) | (F.col("height") > max(source_dpi // 3, 24))
    return rows.withColumn("starts_paragraph", starts).withColumn("is_block", block)


def render_plan(pages: DataFrame, dpi: int, max_pixels: int = 80_000_000) -> DataFrame:
    """``px_width, px_height, ok`` of pages (width, height in points): at least 1, an edge of 16,384 and max_pixels at most."""
    px = lambda c: F.greatest(F.ceil((F.col(c).cast("float") * F.lit(dpi).cast("float") / F.lit(72).cast("float")).cast("float")), F.lit(1))
    out = pages.withColumn("px_width", px("width")).withColumn("px_height", px("height"))
    return out.withColumn("ok", (F.col("px_width") <= 16_384) & (F.col("px_height") <= 16_384) & (F.col("px_width") * F.col("px_height") <= max_pixels))


def _scale(a: Column, b: Column) -> Column:
    return (a.cast("float") / b.cast("float")).cast("float")


def fit_width_slices(images: DataFrame, content_width: int, content_height: int) -> DataFrame:
    """Source slices ``slice, top, rows`` of images (width, height) scaled to the content's width."""
    scale = _scale(F.lit(content_width), F.greatest("width", F.lit(1)))
    chunk = F.greatest(F.floor((F.lit(content_height).cast("float") / scale).cast("float")), F.lit(1))
    out = images.withColumn("chunk", chunk)
    out = out.select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("height") - 1, F.lit(0)), F.col("chunk"))).alias("slice", "top"))
    return out.withColumn("rows", F.least("chunk", F.col("height") - F.col("top")))


def fit_page_box(images: DataFrame, content_width: int, content_height: int, margin: int) -> DataFrame:
    """``box_x, box_y, box_width, box_height``: images scaled whole into the content area, centred."""
    scale = F.least(_scale(F.lit(content_width), F.greatest("width", F.lit(1))), _scale(F.lit(content_height), F.greatest("height", F.lit(1))))
    size = lambda c: F.greatest(F.floor((F.col(c).cast("float") * scale).cast("float").cast("double") + F.lit(0.5)).cast("long"), F.lit(1))
    out = images.withColumn("box_width", size("width")).withColumn("box_height", size("height"))
    place = lambda room, c: (F.lit(margin) + F.floor((F.lit(room) - F.col(c)) / 2)).cast("long")
    return out.withColumn("box_x", place(content_width, "box_width")).withColumn("box_y", place(content_height, "box_height"))
