"""Crops of pages: plans as relations, pixels only for planned rectangles.

A plan names a rectangle of a rendered page; pages without a plan are never
joined to their raster.  Figures come from captions and local graphics,
equations and visual parts from their own regions.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Rect, f
from . import spans as S

KEYS = S.KEYS
#: Smallest crops in pixels by kind, pixels and edge of a rendered page at most, pixels a point.
LEAST = {"figure": (80, 48), "equation": (32, 16), "page": (80, 80)}
MOST_PIXELS, MOST_EDGE, SCALE = 8_000_000, 8192, 2.0


def figure_regions(captions: DataFrame, graphics: DataFrame) -> DataFrame:
    """``region_index, x, y, width, height, text`` above captions (caption_index, rectangle, column, text), tightened to the graphics."""
    captions = S.complete(captions)
    left = F.when(F.col("column") == "Right", f("px") + f("pw") * f(0.51)).otherwise(f("px") + f("pw") * f(0.055))
    right = F.when(F.col("column") == "Left", f("px") + f("pw") * f(0.49)).otherwise(f("px") + f("pw") - f("pw") * f(0.055))
    crops = S.next_captions(captions).filter("usable")
    sides = captions.select(*KEYS, "caption_index", left.alias("x"), (right - left).alias("width"), "text")
    coarse = crops.join(sides, [*KEYS, "caption_index"]).withColumn("region_index", F.col("caption_index"))
    coarse = coarse.withColumn("y", F.col("crop_bottom")).withColumn("height", F.col("crop_top") - F.col("crop_bottom"))
    return S.tighten_regions(coarse, graphics).join(coarse.select(*KEYS, "region_index", "text"), [*KEYS, "region_index"])


def crop_plan(regions: DataFrame, kind: str, scale: float = SCALE) -> DataFrame:
    """Pixel rectangles ``left, top, crop_width, crop_height`` of regions on pages rendered at ``scale``, top-left origin.

    ``status``: ok, rotated (no crop of turned pages), render-too-large or too-small.
    """
    regions = S.complete(regions)
    r, page = Rect.of(), S.page_rect()
    down = lambda x: F.greatest(F.floor(x.cast("float")), F.lit(0)).cast("long")
    up = lambda x: F.ceil(x.cast("float")).cast("long")
    width, height = up(page.w * f(scale)), up(page.h * f(scale))
    out = regions.withColumn("render_width", width).withColumn("render_height", height)
    out = out.withColumn("left", down((r.x - page.x) * f(scale))).withColumn("top", down((page.top - r.top) * f(scale)))
    out = out.withColumn("crop_width", F.least(up((r.right - page.x) * f(scale)), F.col("render_width")) - F.col("left"))
    out = out.withColumn("crop_height", F.least(up((page.top - r.y) * f(scale)), F.col("render_height")) - F.col("top"))
    large = (F.greatest("render_width", "render_height") > MOST_EDGE) | (F.col("render_width") * F.col("render_height") > MOST_PIXELS)
    small = (F.col("crop_width") < LEAST[kind][0]) | (F.col("crop_height") < LEAST[kind][1])
    status = F.when(F.abs("rotation_degrees") >= 1, "rotated").when(large, "render-too-large").when(small, "too-small").otherwise("ok")
    return out.withColumn("status", status)


def png(pixels: np.ndarray) -> bytes:
    """RGB pixels as a PNG file."""
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w, _ = pixels.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(pixels).reshape(h, 3 * w)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def crop_images(plan: DataFrame, rasters: DataFrame, kind: str) -> DataFrame:
    """``region_index, href, content`` (PNG) of planned crops; rasters have the plan's render size."""
    wanted = plan.filter("status = 'ok'").select(*KEYS, "region_index", "left", "top", "crop_width", "crop_height")
    both = wanted.join(rasters.select(*KEYS, "width", "height", "pixels"), KEYS)

    def crop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                page = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)
                out.append(png(page[r.top : r.top + r.crop_height, r.left : r.left + r.crop_width]))
            yield batch[[*KEYS, "region_index"]].assign(content=out)

    images = both.mapInPandas(crop, "doc_id long, page_index long, region_index long, content binary")
    name = F.format_string(f"images/{kind}-%04d-%02d.png", F.col("page_index") + 1, F.col("region_index") + 1)
    return images.select(*KEYS, "region_index", name.alias("href"), "content")


def crop_warnings(plan: DataFrame, kind: str) -> DataFrame:
    """One warning a page and reason for crops that were not made; small crops are dropped without one."""
    told = F.when(F.col("status") == "rotated", f"{kind} images of a rotated page were left out").when(
        F.col("status") == "render-too-large", f"{kind} images need a render that is too large")
    return plan.select(*KEYS, told.alias("text")).filter("text is not null").distinct()
