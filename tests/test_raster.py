"""Rasters: relational operators against arrays, the composer, packages, files, PDF and streams."""

import io
import zipfile
from dataclasses import replace
from xml.dom import minidom

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireworks.operators import compose as C
from quireworks.operators import raster as R
from quireworks.sources import archive, pdf
from quireworks.streaming.composer import compose_stream

SMALL = C.Options(width=160, height=160, margin=10, dpi=72, font_size=8.0, source_dpi=72)


def picture(width, height, *boxes):
    page = np.full((height, width, 3), 255, np.uint8)
    for x, y, w, h in boxes:
        page[y : y + h, x : x + w] = 0
    return page


def random_page(seed):
    rng = np.random.default_rng(seed)
    boxes = [(int(rng.integers(0, 220)), int(rng.integers(0, 180)), int(rng.integers(1, 40)), int(rng.integers(1, 9))) for _ in range(rng.integers(1, 25))]
    return picture(260, 190, *boxes)


def frame(spark, pages):
    return spark.createDataFrame([(1, i, p.shape[1], p.shape[0], bytearray(p.tobytes())) for i, p in enumerate(pages)], "doc_id long, page_index long, width int, height int, pixels binary")


def areas(df, *more):
    return sorted((r["page_index"], *(r[m] for m in more), r["x"], r["y"], r["width"], r["height"]) for r in df.collect())


def test_relational_operators_equal_arrays(spark):
    pages = [random_page(s) for s in range(6)] + [picture(240, 180, (10, 10, 90, 160), (140, 10, 90, 160))]
    runs = R.ink_runs(frame(spark, pages)).cache()
    regions = R.vertical_regions(runs)
    rows = R.ink_rows(runs)
    want = {k: [] for k in ("bounds", "regions", "halves", "rows", "words")}
    for i, p in enumerate(pages):
        dark = C.ink(p, 210)
        box = C.bounds(dark)
        as_row = lambda a: (a.x, a.y, a.width, a.height)
        want["bounds"].append((i, *as_row(box)))
        for k, region in enumerate(C.vertical_regions(dark, box)):
            want["regions"].append((i, k, *as_row(region)))
            want["halves"] += [(i, k, part, *as_row(c)) for part, c in enumerate(C.columns(dark, region, 2))]
        whole = C.Area(0, 0, p.shape[1], p.shape[0])
        for row in C.rows(dark, whole):
            want["rows"].append((i, *as_row(row)))
            want["words"] += [(i, *as_row(w)) for w in C.words(dark, row)]
    assert areas(R.content_bounds(runs)) == sorted(want["bounds"])
    assert areas(regions, "region") == sorted(want["regions"])
    assert areas(R.gutter_splits(runs, regions), "region", "part") == sorted(want["halves"])
    assert areas(rows) == sorted(want["rows"]) and areas(R.word_boxes(runs, rows)) == sorted(want["words"])
    assert (6, 0, 1) in {r[:3] for r in want["halves"]}
    medians = {r["page_index"]: r["median"] for r in R.row_medians(rows).collect()}
    assert medians == {i: C.upper_median([r[4] for r in want["rows"] if r[0] == i]) for i in range(len(pages))}


def test_content_bounds_and_bad_rasters():
    assert C.bounds(C.ink(picture(60, 40, (20, 15, 30, 10)), 210)) == C.Area(20, 15, 30, 10)
    assert C.bounds(C.ink(picture(60, 40), 210)) is None
    with pytest.raises(ValueError):
        R.decode_runs(2, 2, b"\0" * 11, 210)


@pytest.mark.parametrize("bad", [{"width": 100}, {"margin": 80}, {"dpi": 20}, {"font_size": 100.0}, {"max_columns": 3}, {"mode": "x"}, {"max_pixels": 10}])
def test_options_are_checked(bad):
    with pytest.raises(C.ComposeError):
        replace(SMALL, **bad)


def test_reflow_wraps_words_in_order():
    words = picture(400, 40, *[(10 + 45 * i, 10, 30, 8) for i in range(8)])
    pages = list(C.iter_pages(iter([words]), SMALL))
    assert len(pages) == 1
    lines = C.rows(C.ink(pages[0], 210), C.Area(0, 0, 160, 160))
    assert len(lines) >= 2 and sum(len(C.words(C.ink(pages[0], 210), r)) for r in lines) == 8


def test_modes_and_blank_pages():
    tall = picture(100, 1000, (0, 0, 100, 1000))
    fit = list(C.iter_pages(iter([tall, picture(50, 50)]), replace(SMALL, mode=C.FIT_WIDTH)))
    assert len(fit) == 11 and (fit[-1] == 255).all() and all((p[:10] == 255).all() for p in fit)
    whole = list(C.iter_pages(iter([tall]), replace(SMALL, mode=C.FIT_PAGE)))
    assert len(whole) == 1 and C.bounds(C.ink(whole[0], 210)) == C.Area(73, 10, 14, 140)
    assert len(list(C.iter_pages(iter([]), SMALL))) == 1 and len(list(C.iter_pages(iter([picture(50, 50)]), SMALL))) == 1


def test_oversized_words_and_lone_pictures_fit():
    page = list(C.iter_pages(iter([picture(2000, 30, (0, 0, 2000, 20))]), SMALL))[0]
    box = C.bounds(C.ink(page, 210))
    assert box.x >= 10 and box.x + box.width <= 150
    block = list(C.iter_pages(iter([picture(200, 200, (20, 20, 100, 100))]), SMALL))[0]
    assert C.bounds(C.ink(block, 210)).height == 140


def test_draining_keeps_the_open_page_and_the_limit_counts_it():
    c = C.Composer(SMALL)
    c.add(picture(200, 60, (10, 10, 100, 8)))
    assert c.take() == [] and len(c.finish()) == 1 and c.emitted == 1
    with pytest.raises(C.ComposeError):
        list(C.iter_pages(iter([picture(100, 1000, (0, 0, 100, 1000))]), replace(SMALL, mode=C.FIT_WIDTH, max_pixels=160 * 160 * 3)))


def test_pictures_outside_a_page_are_refused():
    c = C.Composer(SMALL)
    before = c.page.copy()
    with pytest.raises(C.ComposeError):
        c._put(picture(5, 5), 158, 0, 5, 5)
    assert (c.page == before).all()


def test_resize_keeps_flat_areas():
    assert (C.resize(np.full((7, 9, 3), 77, np.uint8), 20, 3) == 77).all()
    rgba = np.array([[[10, 20, 30, 255], [5, 10, 15, 128], [0, 0, 0, 0]]], np.uint8)
    assert C.to_rgb(rgba).tolist() == [[[10, 20, 30], [10, 20, 30], [0, 0, 0]]]


def test_documents_compose_in_batch_and_in_streams(spark, tmp_path):
    pages = [random_page(s) for s in range(5)]
    want = [p.tobytes() for p in C.iter_pages(iter(pages), SMALL)]
    got = C.compose_documents(frame(spark, pages), SMALL).orderBy("number").collect()
    assert [bytes(r["pixels"]) for r in got] == want and all(r["error"] is None for r in got)
    broken = C.compose_documents(frame(spark, pages).selectExpr("doc_id", "page_index", "width + 1 as width", "height", "pixels"), SMALL).collect()
    assert len(broken) == 1 and broken[0]["error"]
    source = tmp_path / "in"
    rows = frame(spark, pages).selectExpr("*", "page_index = 4 as last")
    for i, k in enumerate([3, 0, 4, 1, 2]):  # out of order
        rows.filter(f"page_index = {k}").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = compose_stream(stream, SMALL).writeStream.format("memory").queryName("composed").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        done = spark.sql("select * from composed order by number").collect()
    finally:
        query.stop()
    assert [bytes(r["pixels"]) for r in done] == want


def recorded(pages, options, monkeypatch):
    """(x, y, width, height, source height, source width) of everything a document puts down, and its pages."""
    put, calls = C.Composer._put, []

    def note(self, pixels, x, y, width, height):
        calls.append((x, y, width, height, *pixels.shape[:2], self.emitted + len(self.done)))
        put(self, pixels, x, y, width, height)

    monkeypatch.setattr(C.Composer, "_put", note)
    return calls, list(C.iter_pages(iter(pages), options))


def test_a_left_column_ends_before_the_right_one(monkeypatch):
    # two columns of short lines, each line under the height that a gutter search asks for
    boxes = [(x, 20 + 40 * i, 30 + 4 * i + (x > 100), 12) for x in (20, 160) for i in range(4)]
    calls, _ = recorded([picture(300, 200, *boxes)], C.Options(width=400, height=600, margin=10, dpi=72, font_size=12), monkeypatch)
    assert [c[5] for c in calls] == [30, 34, 38, 42, 31, 35, 39, 43]


def test_words_of_a_row_keep_their_proportions(monkeypatch):
    calls, _ = recorded([picture(300, 100, (20, 20, 30, 20), (80, 30, 30, 10))], C.Options(width=400, height=600, margin=10, dpi=72, font_size=12), monkeypatch)
    assert [(c[2], c[3]) for c in calls] == [(18, 12), (18, 6)] and calls[1][0] == 10 + 18 + 3


def test_lines_past_the_margin_turn_the_page(monkeypatch):
    o = C.Options(width=128, height=128, margin=10, dpi=72, font_size=36)
    calls, pages = recorded([picture(200, 400, *[(10, 10 + 60 * i, 60, 20) for i in range(5)])], o, monkeypatch)
    # each line is 36 high with a gap of 7 and a paragraph's 18: two a page
    assert [(c[1], c[6]) for c in calls] == [(10, 0), (71, 0), (10, 1), (71, 1), (10, 2)] and len(pages) == 3
    first = C.Composer(o)
    first.add(picture(200, 400, *[(10, 10 + 60 * i, 60, 20) for i in range(2)]))
    assert len(first.take()) == 1  # the page is handed out as soon as the pen passes its margin


def test_ink_is_never_clipped():
    import pandas as pd

    page = C.text_raster(pd.DataFrame({"y": [0, 2], "x0": [0, 330], "x1": [5, 400]}))
    assert page.shape == (3, 400, 3) and (page[2, 330:400] == 0).all()


# files ------------------------------------------------------------------------------------------------

def chapter(n, **more):
    return dict(number=n, title=f"Title {n} & more", html=f"<p>Text {n}</p>", has_text=True, images=[]) | more


def test_books_are_reproducible_and_well_formed():
    image = dict(href="images/page-0002-01.png", alt="a <b>", kind="end", marker="", bytes=b"png")
    pages = [chapter(1), chapter(2, has_text=False, images=[image])]
    book = archive.package_book("id", "A & B", "EN-us", pages)
    assert book == archive.package_book("id", "A & B", "EN-us", pages)
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        names = z.namelist()
        assert names[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED and z.read("mimetype") == b"application/epub+zip"
        for name in names:
            if name.endswith((".xhtml", ".opf", ".xml")):
                minidom.parseString(z.read(name))
        nav, opf = z.read("book/nav.xhtml").decode(), z.read("book/package.opf").decode()
        assert "text/page-0001.xhtml#page-1" in nav and "Page 2 (image only)" in nav and "en-US" in opf and "2025-01-01" in opf and z.read("book/images/page-0002-01.png") == b"png"


@pytest.mark.parametrize("limit", [{"max_semantic": 100}, {"max_assets": 2}, {"max_archive": 500}])
def test_books_have_limits(limit):
    image = dict(href="a.png", alt="", kind="end", marker="", bytes=b"png")
    with pytest.raises(archive.TooLarge):
        archive.package_book("id", "t", "en", [chapter(1, images=[image])], **limit)


def test_bounded_buffer():
    b = archive.BoundedBuffer(3)
    assert b.write(b"four") == 4 and b.exceeded and b.value() == b""
    with pytest.raises(OSError):
        b.seek(4)


def test_staged_writes(tmp_path):
    path = tmp_path / "out.epub"
    archive.staged_write(path, b"one")
    with pytest.raises(FileExistsError):
        archive.staged_write(path, b"two")
    assert path.read_bytes() == b"one"
    archive.staged_write(path, b"two", force=True)
    assert path.read_bytes() == b"two" and [p.name for p in tmp_path.iterdir()] == ["out.epub"]
    with pytest.raises(OSError):
        archive.staged_write(tmp_path / "none" / "x", b"")


def synthetic(n):
    """A PDF of n pages with one line each."""
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(n))
    bodies = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {n} /Kids [{kids}] /MediaBox [0 0 612 792] >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>"]
    for i in range(n):
        text = f"BT /F1 18 Tf 72 720 Td (Page {i + 1} \\(one\\) line) Tj ET"
        bodies += [f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>", f"<< /Length {len(text)} >>\nstream\n{text}\nendstream"]
    out = "%PDF-1.4\n" + "".join(f"{i} 0 obj\n{b}\nendobj\n" for i, b in enumerate(bodies, 1))
    return (out + f"trailer\n<< /Size {len(bodies) + 1} /Root 1 0 R >>\n%%EOF\n").encode()


def test_documents_are_read(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(synthetic(3))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-not-a-document")
    pages = [picture(60, 80, (5, 5, 20, 20)), picture(60, 80)]
    (tmp_path / "c.pdf").write_bytes(archive.raster_document(archive.compress_pages(pages), 72))
    spans = pdf.read_spans(spark, f"file://{tmp_path}").cache()
    got = {r["path"].rsplit("/", 1)[1]: r for r in pdf.inspect(spans).collect()}
    assert got["a.pdf"]["n_pages"] == 3 and got["c.pdf"]["n_pages"] == 2 and got["b.pdf"]["error"]
    one = spans.filter("text is not null").orderBy("page_index").first()
    assert (one["text"], one["x"], one["y"], one["font_size"], one["font_name"], one["font_weight"], one["media_y1"]) == ("Page 1 (one) line", 72.0, 720.0, 18.0, "Helvetica-Bold", 700, 792.0)
    document = pdf.Document((tmp_path / "c.pdf").read_bytes())
    w, h, rgb = document.picture(document.pages[0][0])
    assert (w, h, rgb) == (60, 80, pages[0].tobytes())


def test_raster_documents_have_a_limit():
    with pytest.raises(archive.TooLarge):
        archive.compress_pages([random_page(1)], 10)


def test_files_become_books(spark, tmp_path):
    from quireworks.operators import convert

    (tmp_path / "a.pdf").write_bytes(synthetic(4))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-not-a-document")
    got = {r["path"].rsplit("/", 1)[1]: r for r in convert.convert_books(spark, f"file://{tmp_path}", "A title", "de").collect()}
    assert got["b.pdf"]["error"] and got["b.pdf"]["content"] is None
    assert got["a.pdf"]["source_pages"] == 4 and got["a.pdf"]["error"] is None
    with zipfile.ZipFile(io.BytesIO(bytes(got["a.pdf"]["content"]))) as z:
        assert len([n for n in z.namelist() if n.startswith("book/text/")]) == 4
        for name in z.namelist():
            if name.endswith((".xhtml", ".opf")):
                minidom.parseString(z.read(name))


def test_raster_files_are_composed_again(spark, tmp_path):
    from quireworks.operators import convert

    pages = [random_page(1), random_page(2)]
    (tmp_path / "c.pdf").write_bytes(archive.raster_document(archive.compress_pages(pages), 72))
    got = C.compose_documents(convert.page_rasters(spark, f"file://{tmp_path}"), SMALL).orderBy("number").collect()
    assert [bytes(r["pixels"]) for r in got] == [p.tobytes() for p in C.iter_pages(iter(pages), SMALL)]


def test_command_line(spark, tmp_path, capsys):
    from quireworks.__main__ import main, output_path, resolve_format

    path = tmp_path / "in.pdf"
    path.write_bytes(synthetic(1))
    assert resolve_format(None, None) == "epub" and resolve_format(None, path) == "pdf" and resolve_format("epub", path) == "epub"
    assert output_path(path, "epub").name == "in.quireworks.epub"
    assert main([str(path)]) == 0 and main([str(path)]) == 1 and main([str(path), "--force"]) == 0
    path.write_bytes(b"%PDF-x")
    assert main([str(path), "--force"]) == 1


def test_crops_follow_captions_and_graphics(spark):
    import zlib as z

    from quireworks.operators import visual as X

    keys = "doc_id long, page_index long, "
    captions = spark.createDataFrame([(1, 0, 0, 60.0, 100.0, 200.0, 10.0, "Left", "Figure 1: a b")], keys + "caption_index long, x float, y float, width float, height float, column string, text string")
    graphics = spark.createDataFrame([(1, 0, 100.0, 150.0, 60.0, 50.0), (1, 0, 400.0, 150.0, 60.0, 50.0)], keys + "x float, y float, width float, height float")
    regions = X.figure_regions(captions, graphics)
    r = regions.first()
    assert (r["x"], r["y"], r["width"], r["height"], r["text"]) == (98.0, 148.0, 64.0, 54.0, "Figure 1: a b")
    plan = X.crop_plan(regions, "figure").cache()
    p = plan.first()
    assert (p["left"], p["top"], p["crop_width"], p["crop_height"], p["status"]) == (196, 1180, 128, 108, "ok")
    page = np.random.default_rng(0).integers(0, 256, (1584, 1224, 3), np.uint8)
    rasters = spark.createDataFrame([(1, 0, 1224, 1584, bytearray(page.tobytes()))], keys + "width int, height int, pixels binary")
    image = X.crop_images(plan, rasters, "figure").first()
    data = bytes(image["content"])
    assert image["href"] == "images/figure-0001-01.png" and data[16:24] == (128).to_bytes(4, "big") + (108).to_bytes(4, "big")
    start = data.index(b"IDAT")
    rows = np.frombuffer(z.decompress(data[start + 4 : start + 4 + int.from_bytes(data[start - 4 : start], "big")]), np.uint8).reshape(108, 1 + 3 * 128)
    assert (rows[:, 1:].reshape(108, 128, 3) == page[1180:1288, 196:324]).all()
    turned = X.crop_plan(regions.selectExpr("*", "cast(90 as float) rotation_degrees"), "figure")
    assert turned.first()["status"] == "rotated" and X.crop_warnings(turned, "figure").count() == 1


def test_runs_compose_like_rasters(spark):
    runs = [(d, p, y, x, x + 20 + 7 * ((d or 5) + x) % 30) for d in (1, 2, None) for p in (1, 0) for line in range(40) for y in (9 * line, 9 * line + 1) for x in (0, 60, 170, 230)]
    frame = spark.createDataFrame(runs, "doc_id long, page_index long, y long, x0 long, x1 long")
    # 3 pages at most: the larger text fails, the smaller one fits
    for size, mode in ((6.0, C.REFLOW), (30.0, C.REFLOW), (6.0, C.FIT_WIDTH)):
        options = C.Options(width=200, height=240, margin=10, dpi=120, font_size=size, mode=mode, max_pixels=3 * 200 * 240)
        pages = C.compose_documents(C.rasterize(frame), options)
        wanted = pages.select("doc_id", "number", "width", "height", F.md5("pixels").alias("pixels"), "error")
        assert set(C.compose_digests(frame, options).collect()) == set(wanted.collect())
        assert set(archive.package_runs(frame, options).collect()) == set(archive.package_rasters(pages, options.dpi).collect())
