"""The catalogue of layout queries and of the SQL that checks them.

``QUERIES`` apply operators to the derived views; ``ORACLES`` hold DuckDB SQL
with the same columns, written against the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions import text as T
from ..functions.geometry import f
from ..operators import compose as C
from ..operators import markup as M
from ..operators import pages as P
from ..operators import raster as R
from ..operators import sequences as Q
from ..operators import spans as S
from ..operators import visual as X
from ..operators.markdown import markdown_to_xhtml
from ..sources import archive
from . import duck as D
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _doubles(df: DataFrame) -> DataFrame:
    """FLOAT columns as DOUBLE, so both engines return one type."""
    return df.select([F.col(n).cast("double").alias(n) if t == "float" else F.col(n) for n, t in df.dtypes])


# text and markup ---------------------------------------------------------------------------

_HEADS = f"SELECT page_id, html, {D.headings('html')} AS h, {D.strip('html')} AS t FROM pages"


@query(f"""SELECT page_id, coalesce(h[1].text, 'Page ' || page_id) AS title, length(replace(t, ' ', '')) AS visible_len, length(replace(t, ' ', '')) >= 20 AS has_text, len(h) AS heading_count FROM ({_HEADS})""")
def page_text_report(spark, sf_dir):
    return P.text_report(_pages(spark, sf_dir))


@query(f"SELECT page_id, {D.strip('html')} AS text FROM pages")
def strip_markup(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", T.strip_markup(F.col("html")).alias("text"))


@query(f"SELECT page_id, i - 1 AS ord, h[i].level AS level, h[i].text AS text FROM ({_HEADS}), unnest(range(1, len(h) + 1)) t(i)")
def headings(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.posexplode(T.headings(F.col("html"))).alias("ord", "h")).select("page_id", F.col("ord").cast("long").alias("ord"), "h.level", "h.text")


@query(f"""SELECT page_id, i - 1 AS k, a[i] AS href, NOT regexp_matches({D.trim('a[i]')}, '[\\x00-\\x1f\\x7f-\\x{{9f}}]') AND (NOT regexp_matches({D.trim('a[i]')}, '^[^:/#?]*:')
 OR lower(regexp_extract({D.trim('a[i]')}, '^([^:/#?]*):', 1)) IN ('http', 'https', 'mailto')) AS safe
FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) a FROM pages), unnest(range(1, len(a) + 1)) t(i)""")
def safe_links(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    links = _pages(spark, sf_dir).select("page_id", F.posexplode(found).alias("k", "href"))
    return links.select("page_id", F.col("k").cast("long").alias("k"), "href", T.is_safe_link(F.col("href")).alias("safe"))


@query(f"SELECT doc_id, md5({D.escape_xml('text')}) AS escaped, length({D.keep_xml('text')}) AS n_kept FROM documents")
def xml_escape(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.escape_xml(F.col("text")).cast("binary")).alias("escaped"), F.length(T.keep_xml(F.col("text"))).cast("long").alias("n_kept"))


@query(f"SELECT doc_id, CASE WHEN regexp_replace(t, '{D.SPACE}', '', 'g') = '' THEN 'Converted document' ELSE t END AS title FROM (SELECT doc_id, substr({D.keep_xml(D.trim('text'))}, 1, 300) t FROM documents)")
def normalized_title(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalized_title(F.col("text")).alias("title"))


@query("""SELECT page_id, CASE WHEN lower(url) LIKE '%.pdf' THEN 'pdf' ELSE 'epub' END AS format, stem, CASE WHEN stem = '' THEN 'Converted document' ELSE stem END AS title,
 regexp_extract(url, '^(?s)(.*/)?', 0) || stem || '.quireworks.' || CASE WHEN lower(url) LIKE '%.pdf' THEN 'pdf' ELSE 'epub' END AS output
FROM (SELECT page_id, url, regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '^(?s)(.+)\\.[^.]*$', '\\1') AS stem FROM pages)""")
def output_names(spark, sf_dir):
    url = F.col("url")
    kind = T.output_format(F.lit(None).cast("string"), url)
    folder = F.regexp_extract(url, "^(?s)(.*/)?", 0)
    return _pages(spark, sf_dir).select(
        "page_id", kind.alias("format"), T.file_stem(url).alias("stem"), T.input_title(url).alias("title"), F.concat(folder, T.file_stem(url), F.lit(".quireworks."), kind).alias("output"))


@query("""SELECT doc_id, printf('%016x', h::UBIGINT) AS id FROM (SELECT doc_id, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: CAST('0x' || b AS HUGEINT))),
 lambda a, b: ((a - a % 256 + xor((a % 256)::INT, b::INT)) * 1099511628211) % 18446744073709551616) AS h FROM documents)""")
def document_identifier(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", scalar.document_identifier(F.col("text").cast("binary")).alias("id"))


@query(f"{V.duck('v_lines')}SELECT doc_id, line_no, {D.math_syntax('text')} AS n_math, {D.letters('text')} AS n_letters FROM v_lines")
def math_syntax(spark, sf_dir):
    return V.lines(spark, sf_dir).select("doc_id", "line_no", T.math_syntax_count(F.col("text")).cast("long").alias("n_math"), T.letters(F.col("text")).cast("long").alias("n_letters"))


@query(f"""{V.duck('v_blocks')}SELECT page_id, string_agg(markup || chr(10), '' ORDER BY block_no) AS html, count(*) AS n_blocks FROM v_blocks WHERE {D.trustworthy('tag', 'markup')} GROUP BY page_id""")
def prose_blocks(spark, sf_dir):
    return P.trustworthy_prose(V.blocks(spark, sf_dir), ["page_id"])


@query(f"""{V.duck('v_lines')}SELECT doc_id, line_no, {D.section_heading('text', 'body')} AS is_heading FROM (SELECT *, coalesce(lead(text) OVER (PARTITION BY doc_id ORDER BY line_no), '') AS body FROM v_lines)""")
def section_headings(spark, sf_dir):
    from pyspark.sql.window import Window

    body = F.coalesce(F.lead("text").over(Window.partitionBy("doc_id").orderBy("line_no")), F.lit(""))
    return V.lines(spark, sf_dir).withColumn("body", body).select("doc_id", "line_no", T.is_section_heading(F.col("text"), F.col("body")).alias("is_heading"))


# running text ------------------------------------------------------------------------------

_RUNNING = f"""SELECT doc_id, zone, text, n_pages FROM (SELECT doc_id, zone, t AS text, count(DISTINCT page_index) AS n_pages FROM (
 SELECT doc_id, page_index, {D.running('text')} AS t, unnest(list_filter([CASE WHEN y > CAST(792 AS FLOAT) * CAST(0.85 AS FLOAT) THEN 'header' END, CASE WHEN y + height < CAST(792 AS FLOAT) * CAST(0.15 AS FLOAT) THEN 'footer' END], lambda z: z IS NOT NULL)) AS zone
 FROM v_spans) WHERE strlen(t) > 3 GROUP BY ALL) JOIN (SELECT doc_id, count(DISTINCT page_index) AS pages FROM v_spans GROUP BY ALL) USING (doc_id)
WHERE pages >= 3 AND n_pages >= greatest(ceil(CAST(pages AS FLOAT) * CAST(0.6 AS FLOAT)), 2)"""


@query(f"{V.duck('v_spans')}{_RUNNING}")
def running_text(spark, sf_dir):
    return P.repeated_running_text(V.spans(spark, sf_dir))


def _span_blocks(spark, sf_dir):
    return V.spans(spark, sf_dir).selectExpr("doc_id", "page_index", "case when span_index = 100 then 0L else span_index + 1 end as block_no", "concat('<p>', text, '</p>') as markup")


@query(f"""{V.duck('v_spans', running=_RUNNING, b=f"SELECT doc_id, page_index, CASE WHEN span_index = 100 THEN 0 ELSE span_index + 1 END AS block_no, {D.running(D.strip('text'))} AS norm FROM v_spans", e="SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY block_no) AS s, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY block_no DESC) AS t FROM b")}
SELECT doc_id, page_index, block_no FROM (SELECT e.*,
 s <= 2 AND EXISTS (FROM running r WHERE r.doc_id = e.doc_id AND r.zone = 'header' AND r.text = e.norm) AND NOT EXISTS (FROM e o WHERE o.doc_id = e.doc_id AND o.page_index = e.page_index AND o.norm = e.norm AND o.s < e.s) AS head,
 t <= 2 AND EXISTS (FROM running r WHERE r.doc_id = e.doc_id AND r.zone = 'footer' AND r.text = e.norm) AND NOT EXISTS (FROM e o WHERE o.doc_id = e.doc_id AND o.page_index = e.page_index AND o.norm = e.norm AND o.t < e.t) AS foot
FROM e) WHERE NOT head AND NOT foot""")
def strip_running(spark, sf_dir):
    repeated = P.repeated_running_text(V.spans(spark, sf_dir)).select("doc_id", "zone", "text")
    return P.strip_running_blocks(_span_blocks(spark, sf_dir), repeated, ["doc_id", "page_index"]).select("doc_id", "page_index", "block_no")


# page statistics -----------------------------------------------------------------------------

@query(f"{V.duck('v_spans', b=D.body('v_spans'))}SELECT doc_id, page_index, CAST(body AS DOUBLE) AS body FROM b")
def body_font_median(spark, sf_dir):
    return _doubles(S.body_font_sizes(V.spans(spark, sf_dir)))


@query(f"{V.duck('v_spans', c=D.columns('v_spans'))}SELECT * FROM c")
def two_column_pages(spark, sf_dir):
    return S.two_column_pages(V.spans(spark, sf_dir))


_MATH = D.is_math("font_name", "text")
_SOLID = f"length(regexp_replace(text, '{D.SPACE}', '', 'g'))"


@query(f"""{V.duck('v_spans')}SELECT doc_id, page_index, count(*) AS n_content, count(*) FILTER ({_MATH}) AS n_math, CAST(coalesce(sum({_SOLID}) FILTER ({_MATH}), 0) AS BIGINT) AS math_chars,
 n_math >= 5 AND math_chars >= 100 AND 3 * n_math >= n_content AS math_dense FROM v_spans WHERE {_SOLID} > 0 GROUP BY ALL""")
def math_dense_pages(spark, sf_dir):
    return S.math_density(V.spans(spark, sf_dir), least_spans=5)


@query(f"""{V.duck('v_spans', b=D.body('v_spans'))}SELECT doc_id, page_index, m.font_name AS font_name, m.n AS letters FROM (SELECT doc_id, page_index, max({{'n': n, 'font_name': font_name}}) AS m FROM (
 SELECT doc_id, page_index, font_name, CAST(sum({D.letters('text')}) AS BIGINT) AS n FROM v_spans JOIN b USING (doc_id, page_index)
 WHERE {D.letters('text')} > 0 AND font_size >= body * CAST(0.8 AS FLOAT) AND font_size <= body * CAST(1.3 AS FLOAT) GROUP BY ALL) GROUP BY ALL)""")
def dominant_font(spark, sf_dir):
    return S.dominant_fonts(V.spans(spark, sf_dir))


@query(f"""{V.duck('v_spans', b=D.body('v_spans'))}SELECT doc_id, page_index, CAST(min(x) FILTER (x < 306) AS DOUBLE) AS left_x, CAST(min(x) FILTER (x >= 306) AS DOUBLE) AS right_x FROM v_spans JOIN b USING (doc_id, page_index)
 WHERE {D.letters('text')} > 0 AND font_size >= body * CAST(0.8 AS FLOAT) AND font_size <= body * CAST(1.3 AS FLOAT) GROUP BY ALL""")
def column_starts(spark, sf_dir):
    return _doubles(S.column_starts(V.spans(spark, sf_dir)))


@query(f"""{V.duck('v_spans', t="SELECT * FROM v_spans WHERE y + height >= CAST(792 AS FLOAT) * CAST(0.6 AS FLOAT) AND width >= 0 AND width <= 612 AND height > 0 AND length(text) > 0 AND x + width <= 613 AND y + height <= 793")}
SELECT doc_id, page_index, span_index, CAST(m AS DOUBLE) AS largest, font_size >= greatest(m * CAST(0.88 AS FLOAT), 11) AS is_title FROM t JOIN (
 SELECT doc_id, page_index, max(font_size) FILTER (regexp_matches(text, '[\\p{{L}}\\p{{N}}]')) AS m FROM t GROUP BY ALL) USING (doc_id, page_index)""")
def title_spans(spark, sf_dir):
    return _doubles(S.title_spans(V.spans(spark, sf_dir)).select("doc_id", "page_index", "span_index", "largest", "is_title"))


# rectangles ------------------------------------------------------------------------------------

_SHARE = D.overlap(("s.x", "s.y", "s.width", "s.height"), ("i.bx", "i.by_", "i.bw", "i.bh"))


@query(f"{V.duck('v_spans', 'v_images')}SELECT s.doc_id, s.page_index, span_index, CAST(coalesce(max({_SHARE}), 0) AS DOUBLE) AS overlap FROM v_spans s LEFT JOIN v_images i USING (doc_id, page_index) GROUP BY ALL")
def rect_overlap(spark, sf_dir):
    return _doubles(S.overlaps(V.spans(spark, sf_dir), V.image_regions(spark, sf_dir)))


@query(f"{V.duck('v_spans', 'v_images')}SELECT doc_id, page_index, span_index FROM v_spans s WHERE NOT EXISTS (FROM v_images i WHERE i.doc_id = s.doc_id AND i.page_index = s.page_index AND {_SHARE} >= 0.25)")
def overlap_anti(spark, sf_dir):
    return S.outside_regions(V.spans(spark, sf_dir), V.image_regions(spark, sf_dir)).select("doc_id", "page_index", "span_index")


@query(f"{V.duck('v_spans', 'v_images')}SELECT doc_id, page_index, span_index FROM v_spans s WHERE EXISTS (FROM v_images i WHERE i.doc_id = s.doc_id AND i.page_index = s.page_index AND {_SHARE} >= 0.5)")
def overlap_semi(spark, sf_dir):
    return S.inside_regions(V.spans(spark, sf_dir), V.image_regions(spark, sf_dir), 0.5).select("doc_id", "page_index", "span_index")


@query(f"""{V.duck('v_spans', 'v_images')}SELECT doc_id, page_index, region_index, CAST(greatest(l - 2, bx) AS DOUBLE) AS x, CAST(greatest(b - 2, by_) AS DOUBLE) AS y,
 CAST(least(r + 2, bx + bw) - greatest(l - 2, bx) AS DOUBLE) AS width, CAST(least(t + 2, by_ + bh) - greatest(b - 2, by_) AS DOUBLE) AS height FROM (
 SELECT i.doc_id, i.page_index, image_index AS region_index, bx, by_, bw, bh, min(greatest(s.x, bx)) l, min(greatest(s.y, by_)) b, max(least(s.x + s.width, bx + bw)) r, max(least(s.y + s.height, by_ + bh)) t
 FROM v_images i JOIN v_spans s USING (doc_id, page_index)
 WHERE s.width <= bw * CAST(1.2 AS FLOAT) AND s.height <= bh * CAST(1.2 AS FLOAT) AND s.x + s.width * 0.5::FLOAT BETWEEN bx AND bx + bw AND s.y + s.height * 0.5::FLOAT BETWEEN by_ AND by_ + bh
  AND least(s.x + s.width, bx + bw) > greatest(s.x, bx) AND least(s.y + s.height, by_ + bh) > greatest(s.y, by_) GROUP BY ALL) WHERE r - l >= 24 AND t - b >= 24""")
def figure_tighten(spark, sf_dir):
    return _doubles(S.tighten_regions(V.image_regions(spark, sf_dir), V.spans(spark, sf_dir).select("doc_id", "page_index", "x", "y", "width", "height")))


_CAPTIONS = "select doc_id, page_index, span_index as caption_index, x, y, width, height, case when font_size = 16 then 'Full' when x < 306 then 'Left' else 'Right' end as {0} from {1} where font_name = 'Heading' or font_size = 16"


@query(f"""{V.duck('v_spans', c=_CAPTIONS.format('col', 'v_spans'))}SELECT doc_id, page_index, caption_index, CAST(crop_bottom AS DOUBLE) AS crop_bottom, CAST(top AS DOUBLE) AS crop_top, top - crop_bottom >= 24 AS usable FROM (
 SELECT *, least(crop_bottom + 225, 772, coalesce(n - 8, 772)) AS top FROM (SELECT c.doc_id, c.page_index, c.caption_index, c.y + c.height + 2 AS crop_bottom,
  (SELECT arg_min(o.y, o.caption_index) FROM c o WHERE o.doc_id = c.doc_id AND o.page_index = c.page_index AND o.y > c.y AND (o.col = c.col OR o.col = 'Full' OR c.col = 'Full')) AS n FROM c))""")
def next_caption(spark, sf_dir):
    V.spans(spark, sf_dir).createOrReplaceTempView("_spans_for_captions")
    return _doubles(S.next_captions(spark.sql(_CAPTIONS.format("`column`", "_spans_for_captions"))))


# equations, captions, tables: spans with formulas, numbers and table rows laid in -----------------

_EQ = """select doc_id, page_index, span_index,
 case when m = 4 then concat('(', cast({div} as {string}), ')') when m = 2 then 'alpha = beta' when m = 6 then 'Total' when m = 7 then concat('score value ', text) when m = 8 then concat('Figure ', cast({div} as {string}), ': ', text) else text end as text,
 cast(case when m = 4 then 560 when m = 2 then 400 when m in (1, 3, 5) then 54 when m = 7 then 150 else x end as float) as x, y, cast(case when m = 4 then 20 when m = 2 then 60 else width end as float) as width, height,
 case when m = 2 then 'CMMI10' when m in (6, 7) then 'Bold' else font_name end as font_name, font_size, case when m in (6, 7) then 700 else font_weight end as font_weight
from (select *, span_index % 10 as m from {spans}) _s"""
_DUCK_EQ = _EQ.format(div="span_index // 10", string="varchar", spans="v_spans")


def _equation_spans(spark, sf_dir):
    V.spans(spark, sf_dir).createOrReplaceTempView("_spans_for_equations")
    return spark.sql(_EQ.format(div="span_index div 10", string="string", spans="_spans_for_equations"))


_EQ_NUMBER = f"regexp_matches({D.trim('text')}, '^\\([0-9a-z]{{1,6}}\\)$') AND regexp_matches(text, '[0-9]')"


@query(f"""{V.duck('v_spans', v_eq=_DUCK_EQ, b=D.body('v_eq'), c=D.columns('v_eq'), s="SELECT *, x + width * 0.5::FLOAT AS cx, y + height * 0.5::FLOAT AS cy FROM v_eq JOIN b USING (doc_id, page_index) JOIN c USING (doc_id, page_index)",
 n=f"SELECT * FROM (SELECT *, CASE WHEN two_columns AND cx >= 306 THEN 306 ELSE 0 END AS low, CASE WHEN two_columns AND cx < 306 THEN 306 ELSE 612 END AS high FROM s WHERE {_EQ_NUMBER}) WHERE cx >= low + (high - low) * CAST(0.78 AS FLOAT)")}
SELECT doc_id, page_index, span_index, anchor, n_spans, CAST(l AS DOUBLE) AS x, CAST(bo AS DOUBLE) AS y, CAST(r - l AS DOUBLE) AS width, CAST(t - bo AS DOUBLE) AS height FROM (
 SELECT n.doc_id, n.page_index, n.span_index, n.text AS anchor, n.body, count(*) AS n_spans, bool_or({D.mixed_prose('s.font_name', 's.text')}) AS prose, bool_or({D.is_math('s.font_name', 's.text')}) AS math,
  bool_or({D.relation('s.text')}) AS rel, min(s.x) l, min(s.y) bo, max(s.x + s.width) r, max(s.y + s.height) t
 FROM n JOIN s ON s.doc_id = n.doc_id AND s.page_index = n.page_index AND s.span_index <> n.span_index AND s.cx >= n.low AND s.cx < n.x - n.body * CAST(0.4 AS FLOAT) AND abs(s.cy - n.cy) <= n.body * CAST(1.6 AS FLOAT)
 WHERE NOT EXISTS (FROM n o WHERE o.doc_id = n.doc_id AND o.page_index = n.page_index AND o.span_index <> n.span_index AND o.low = n.low AND o.high = n.high AND o.span_index <> s.span_index AND abs(s.cy - o.cy) < abs(s.cy - n.cy))
 GROUP BY ALL) WHERE n_spans >= 2 AND NOT prose AND math AND rel AND r - l >= body * 4 AND t - bo >= body * CAST(0.7 AS FLOAT)""")
def numbered_equations(spark, sf_dir):
    return _doubles(S.numbered_equations(_equation_spans(spark, sf_dir)))


_COMPONENTS = f"""SELECT *, sum(cut) OVER (PARTITION BY doc_id, page_index, y ORDER BY x, span_index) AS component FROM (SELECT s.*, body, CASE WHEN x - max(x + width) OVER (PARTITION BY doc_id, page_index, y ORDER BY x, span_index
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > body * CAST(2.5 AS FLOAT) THEN 1 ELSE 0 END AS cut FROM v_eq s JOIN b USING (doc_id, page_index) WHERE {_SOLID} > 0)"""


@query(f"""{V.duck('v_spans', v_eq=_DUCK_EQ, b=D.body('v_eq'), c=_COMPONENTS)}SELECT doc_id, page_index, CAST(y AS DOUBLE) AS y, CAST(component AS BIGINT) AS component, count(*) AS n_spans, CAST(min(x) AS DOUBLE) AS x,
 CAST(max(x + width) - min(x) AS DOUBLE) AS width FROM c GROUP BY doc_id, page_index, c.y, c.component""")
def span_components(spark, sf_dir):
    return _doubles(S.component_boxes(_equation_spans(spark, sf_dir)))


_VETO = " OR ".join(f"starts_with(ltrim(text), '{v}')" for v in T.VETO_LABELS)


@query(f"""{V.duck('v_spans', v_eq=_DUCK_EQ, b=D.body('v_eq'), k=D.columns('v_eq'), c=_COMPONENTS)}SELECT doc_id, page_index, CAST(y AS DOUBLE) AS y, CAST(component AS BIGINT) AS component, CAST(l AS DOUBLE) AS x, CAST(w AS DOUBLE) AS width,
 CAST(chars AS BIGINT) AS chars, CAST(math_chars AS BIGINT) AS math_chars, CAST(n_words AS BIGINT) AS n_words FROM (SELECT *, CASE WHEN two_columns AND mid >= 306 THEN 306 ELSE 0 END AS low, CASE WHEN two_columns AND mid < 306 THEN 306 ELSE 612 END AS high FROM (
 SELECT c.doc_id, c.page_index, c.y, c.component, c.body, k.two_columns, bool_or({_VETO}) AS veto, sum({_SOLID}) AS chars, coalesce(sum({_SOLID}) FILTER ({_MATH}), 0) AS math_chars, coalesce(sum({D.real_words('text')}) FILTER (NOT {_MATH}), 0) AS n_words,
  bool_or({D.relation('text')}) AS rel, min(x) AS l, max(x + width) - min(x) AS w, min(x) + (max(x + width) - min(x)) * 0.5::FLOAT AS mid FROM c JOIN k USING (doc_id, page_index) GROUP BY ALL))
WHERE NOT veto AND rel AND n_words <= 8 AND chars >= 6 AND math_chars * 5 >= chars AND w >= body * 4 AND w <= (high - low) * CAST(0.78 AS FLOAT) AND l - low >= (high - low) * CAST(0.1 AS FLOAT) AND high - l - w >= (high - low) * CAST(0.1 AS FLOAT)""")
def display_formulas(spark, sf_dir):
    return _doubles(S.formula_components(_equation_spans(spark, sf_dir)))


@query(f"""{V.duck('v_spans', v_eq=_DUCK_EQ, b=D.body('v_eq'))}SELECT doc_id, page_index, span_index AS box_index, NOT EXISTS (FROM v_eq o WHERE o.doc_id = s.doc_id AND o.page_index = s.page_index AND o.span_index <> s.span_index
 AND least(s.x + s.width, o.x + o.width) > greatest(s.x, o.x) AND (CASE WHEN s.y + s.height < o.y THEN o.y - s.y - s.height WHEN o.y + o.height < s.y THEN s.y - o.y - o.height ELSE 0 END) < body * CAST(0.75 AS FLOAT)) AS isolated
FROM v_eq s JOIN b USING (doc_id, page_index) WHERE {_MATH}""")
def isolated_formulas(spark, sf_dir):
    spans = _equation_spans(spark, sf_dir)
    boxes = spans.filter(T.is_math_span(F.col("font_name"), F.col("text"))).join(S.body_font_sizes(spans), S.KEYS)
    boxes = boxes.withColumn("box_index", F.col("span_index")).withColumn("low", f(0)).withColumn("high", f(612))
    return S.isolation(boxes, spans).select("doc_id", "page_index", "box_index", "isolated")


_TOKEN = "upper(replace(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g'), 'ß', 'SS'))"


@query(f"{V.duck('v_spans')}SELECT doc_id, page_index, {_TOKEN} AS token, count(*) AS n_anchors, min(span_index) AS first_span FROM v_spans WHERE {_TOKEN} <> '' GROUP BY ALL HAVING count(*) <= 8")
def anchor_index(spark, sf_dir):
    return S.anchor_tokens(V.spans(spark, sf_dir))


_LINES = "list_transform(list_filter(regexp_split_to_array(text, '[ ]+'), lambda z: z <> ''), lambda z: z)"


@query(f"""{V.duck('v_spans', v_eq=_DUCK_EQ, l=f"SELECT *, {_LINES} AS w FROM v_eq", k="SELECT l.*, i FROM l, unnest(range(1, len(w) + 1)) t(i)")}SELECT doc_id, page_index, span_index AS line_index, array_to_string(w[i:], ' ') AS text,
 CASE WHEN abs(cx - 306) < 612 * CAST(0.12 AS FLOAT) OR ww > 612 * CAST(0.48 AS FLOAT) THEN 'Full' WHEN cx < 306 THEN 'Left' ELSE 'Right' END AS col, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY span_index) - 1 AS caption_index FROM (
 SELECT *, 10 * (len(w) - i) + 8 AS ww, x + 10 * (i - 1) + (10 * (len(w) - i) + 8) * 0.5::FLOAT AS cx, row_number() OVER (PARTITION BY doc_id, page_index, span_index ORDER BY i) AS rk FROM k
 WHERE lower(regexp_replace(w[i], '^\\P{{L}}+|\\P{{L}}+$', '', 'g')) = 'figure' AND regexp_matches(coalesce(w[i + 1], ''), '^\\+?[0-9]{{1,5}}:+$') AND CAST(regexp_extract(w[i + 1], '[0-9]+') AS INT) <= 65535 AND len(w) - i + 1 >= 4) WHERE rk = 1""")
def figure_captions(spark, sf_dir):
    lines = _equation_spans(spark, sf_dir).selectExpr(
        "doc_id", "page_index", "span_index as line_index", "x", "y",
        "transform(filter(split(text, '[ ]+'), z -> z <> ''), (z, i) -> struct(z as text, cast(x + 10 * i as float) as x, y as y, cast(8 as float) as width, cast(10 as float) as height)) as words").drop("x", "y")
    return S.figure_captions(lines).select("doc_id", "page_index", "line_index", "text", F.col("column").alias("col"), F.col("caption_index").cast("long").alias("caption_index"))


@query(f"""{V.duck('v_spans', v_eq=_DUCK_EQ, b=D.body('v_eq'), s="SELECT *, " + f"{_TOKEN} AS token, list_filter(list_transform({D.words('text')}, lambda z: upper(regexp_replace(z, '[^\\p{{L}}\\p{{N}}]', '', 'g'))), lambda z: z <> '') AS tw FROM v_eq JOIN b USING (doc_id, page_index)",
 h="SELECT doc_id, page_index, span_index AS heading_index, ['TOTAL', 'SCORE'] AS wanted FROM s WHERE text = 'Total'")}
SELECT DISTINCT doc_id, page_index, heading_index FROM (SELECT h.doc_id, h.page_index, h.heading_index, a.span_index, h.wanted, (SELECT flatten(list(r.tw ORDER BY r.x, r.span_index)) FROM s r WHERE r.doc_id = a.doc_id AND r.page_index = a.page_index AND r.font_name = a.font_name
  AND r.font_weight = a.font_weight AND abs(r.font_size - a.font_size) <= a.body * CAST(0.05 AS FLOAT) AND abs(r.y - a.y) <= a.body * CAST(0.2 AS FLOAT) AND ((a.x + a.width * 0.5::FLOAT < 306 AND r.x + r.width <= 306) OR (a.x + a.width * 0.5::FLOAT >= 306 AND r.x >= 306))) AS found
 FROM h JOIN s a ON a.doc_id = h.doc_id AND a.page_index = h.page_index AND a.token = h.wanted[1] WHERE a.font_weight >= 500 AND a.font_size >= a.body * CAST(0.8 AS FLOAT) AND a.font_size <= a.body * CAST(1.15 AS FLOAT)
  AND (SELECT count(*) FROM s q WHERE q.doc_id = a.doc_id AND q.page_index = a.page_index AND q.token = h.wanted[1]) <= 8)
WHERE len(list_filter(range(0, greatest(len(found) - 2, 0) + 1), lambda i: found[i + 1 : i + 2] = wanted)) > 0
 AND len(list_filter(found[1 : list_filter(range(0, greatest(len(found) - 2, 0) + 1), lambda i: found[i + 1 : i + 2] = wanted)[1]] || found[list_filter(range(0, greatest(len(found) - 2, 0) + 1), lambda i: found[i + 1 : i + 2] = wanted)[1] + 3 :], lambda z: {D.letters('z')} >= 3)) > 0""")
def table_row_headings(spark, sf_dir):
    spans = _equation_spans(spark, sf_dir)
    heads = spans.filter("text = 'Total'").selectExpr("doc_id", "page_index", "span_index as heading_index", "'Total score' as text")
    return S.table_row_headings(spans, heads)


@query(f"""{V.duck('v_spans', v_eq=_DUCK_EQ, b=D.body('v_eq'), x="SELECT doc_id, page_index, min(text) AS html FROM v_eq GROUP BY ALL")}SELECT *, (source >= 6 AND 2 * greatest(extracted - beside, 0) < source) OR (fragments >= 100 AND scripts >= 12) AS unreliable FROM (
 SELECT doc_id, page_index, CAST(coalesce(sum({D.math_syntax('text')}) FILTER ({_MATH}), 0) AS BIGINT) AS source, CAST(coalesce(sum({D.math_syntax('text')}) FILTER (NOT {_MATH}), 0) AS BIGINT) AS beside, count(*) FILTER ({_MATH} AND {_SOLID} <= 2) AS fragments,
  count(*) FILTER ({_MATH} AND font_size <= body * CAST(0.82 AS FLOAT)) AS scripts FROM v_eq JOIN b USING (doc_id, page_index) GROUP BY ALL) JOIN (SELECT doc_id, page_index, {D.math_syntax(D.strip('html'))} AS extracted FROM x) USING (doc_id, page_index)""")
def unreliable_math(spark, sf_dir):
    spans = _equation_spans(spark, sf_dir)
    return S.unreliable_math(spans, spans.groupBy("doc_id", "page_index").agg(F.min("text").alias("html")))


# rasters -----------------------------------------------------------------------------------------

_BOUNDS = "SELECT doc_id, page_index, min(x0) AS x, min(y) AS y, max(x1) - min(x0) AS width, max(y) - min(y) + 1 AS height FROM v_runs GROUP BY ALL"
_ROWS = """SELECT doc_id, page_index, min(a) AS x, min(y) AS y, max(b) - min(a) AS width, count(*) AS height FROM (SELECT doc_id, page_index, y, min(x0) AS a, max(x1) AS b, y - row_number() OVER (PARTITION BY doc_id, page_index ORDER BY y) AS g
 FROM v_runs GROUP BY doc_id, page_index, y) GROUP BY doc_id, page_index, g"""
_REGIONS = f"""SELECT doc_id, page_index, CAST(region AS BIGINT) AS region, any_value(bx) AS x, min(y) AS y, any_value(bw) AS width, max(y) - min(y) + 1 AS height FROM (
 SELECT *, sum(cut) OVER (PARTITION BY doc_id, page_index ORDER BY y) AS region FROM (SELECT r.doc_id, r.page_index, r.y, o.x AS bx, o.width AS bw, CASE WHEN r.y - lag(r.y) OVER (PARTITION BY r.doc_id, r.page_index ORDER BY r.y) - 1 >= greatest(o.height // 100, 8) THEN 1 ELSE 0 END AS cut
 FROM (SELECT DISTINCT doc_id, page_index, y FROM v_runs) r JOIN ({_BOUNDS}) o USING (doc_id, page_index))) GROUP BY doc_id, page_index, region"""


@query(f"{V.duck('v_runs')}{_BOUNDS}")
def content_bounds(spark, sf_dir):
    return R.content_bounds(V.runs(spark, sf_dir))


@query(f"{V.duck('v_runs')}{_ROWS}")
def ink_rows(spark, sf_dir):
    return R.ink_rows(V.runs(spark, sf_dir))


@query(f"{V.duck('v_runs')}{_REGIONS}")
def vertical_regions(spark, sf_dir):
    return R.vertical_regions(V.runs(spark, sf_dir))


@query(f"""{V.duck('v_runs', reg=_REGIONS, w="SELECT * FROM reg WHERE width >= 128 AND height >= 48", ink="SELECT w.doc_id, w.page_index, w.region, w.width, w.height, w.x, px, count(r.y) AS n FROM (SELECT *, unnest(range(0, width)) AS px FROM w) w LEFT JOIN v_runs r ON r.doc_id = w.doc_id AND r.page_index = w.page_index AND r.y >= w.y AND r.y < w.y + w.height AND r.x0 <= w.x + px AND r.x1 > w.x + px GROUP BY ALL",
 gaps="SELECT doc_id, page_index, region, width, count(*) AS gap, min(px) AS s FROM (SELECT *, px - row_number() OVER (PARTITION BY doc_id, page_index, region ORDER BY px) AS g FROM ink WHERE n <= greatest(height // 100, 1)) GROUP BY doc_id, page_index, region, width, g",
 best="SELECT * FROM (SELECT *, s + gap // 2 AS split, row_number() OVER (PARTITION BY doc_id, page_index, region ORDER BY gap DESC, abs(s + gap // 2 - width // 2), s DESC) AS rk FROM gaps WHERE gap >= greatest(width // 50, 6) AND s + gap // 2 >= width // 4 AND width - s - gap // 2 >= width // 4) WHERE rk = 1")}
SELECT r.doc_id, r.page_index, r.region, part, CASE WHEN part = 0 THEN r.x ELSE r.x + split END AS x, r.y, CASE WHEN split IS NULL THEN r.width WHEN part = 0 THEN split ELSE r.width - split END AS width, r.height
FROM reg r LEFT JOIN best USING (doc_id, page_index, region), (VALUES (0), (1)) v(part) WHERE part = 0 OR split IS NOT NULL""")
def gutter_splits(spark, sf_dir):
    runs = V.runs(spark, sf_dir)
    return R.gutter_splits(runs, R.vertical_regions(runs))


@query(f"""{V.duck('v_runs', rows=_ROWS, j="SELECT r.doc_id, r.page_index, o.y AS row_y, o.height AS h, r.y, r.x0, r.x1 FROM v_runs r JOIN rows o ON o.doc_id = r.doc_id AND o.page_index = r.page_index AND r.y >= o.y AND r.y < o.y + o.height",
 k="SELECT *, CASE WHEN x0 - max(x1) OVER (PARTITION BY doc_id, page_index, row_y ORDER BY x0, x1, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > greatest(h // 5, 1) THEN 1 ELSE 0 END AS cut FROM j")}
SELECT doc_id, page_index, row_y, CAST(word AS BIGINT) AS word, min(x0) AS x, min(y) AS y, max(x1) - min(x0) AS width, max(y) - min(y) + 1 AS height FROM (SELECT *, sum(cut) OVER (PARTITION BY doc_id, page_index, row_y ORDER BY x0, x1, y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS word FROM k) GROUP BY doc_id, page_index, row_y, word""")
def word_boxes(spark, sf_dir):
    runs = V.runs(spark, sf_dir)
    return R.word_boxes(runs, R.ink_rows(runs))


@query(f"{V.duck('v_runs', rows=_ROWS)}SELECT doc_id, page_index, list_sort(list(height))[count(*) // 2 + 1] AS median FROM rows GROUP BY ALL")
def row_medians(spark, sf_dir):
    return R.row_medians(R.ink_rows(V.runs(spark, sf_dir)))


@query(f"""{V.duck('v_runs', rows=_ROWS, m="SELECT doc_id, page_index, list_sort(list(height))[count(*) // 2 + 1] AS median FROM rows GROUP BY ALL")}SELECT doc_id, page_index, y, coalesce(greatest(y - lag(y + height) OVER w, 0) > median OR abs(x - lag(x) OVER w) > 2 * median, false) AS starts_paragraph,
 height > 5 * median // 2 OR height > 50 AS is_block FROM rows JOIN m USING (doc_id, page_index) WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY y, x)""")
def paragraph_breaks(spark, sf_dir):
    return R.paragraph_breaks(R.ink_rows(V.runs(spark, sf_dir))).select("doc_id", "page_index", "y", "starts_paragraph", "is_block")


@query(f"""{V.duck('v_images')}SELECT doc_id, page_index, w AS px_width, h AS px_height, w <= 16384 AND h <= 16384 AND w * h <= 4000000 AS ok FROM (SELECT doc_id, page_index, greatest(CAST(ceil(CAST(width AS FLOAT) * 150 / 72) AS BIGINT), 1) AS w, greatest(CAST(ceil(CAST(height AS FLOAT) * 150 / 72) AS BIGINT), 1) AS h FROM v_images)""")
def render_plan(spark, sf_dir):
    return R.render_plan(V.images(spark, sf_dir), 150, 4_000_000).select("doc_id", "page_index", "px_width", "px_height", "ok")


@query(f"""{V.duck('v_images', c="SELECT *, greatest(CAST(floor(CAST(1000 AS FLOAT) / (CAST(700 AS FLOAT) / CAST(width AS FLOAT))) AS BIGINT), 1) AS chunk FROM v_images")}SELECT doc_id, page_index, i AS slice, i * chunk AS top, least(chunk, height - i * chunk) AS rows FROM c, unnest(range(0, (height - 1) // chunk + 1)) t(i)""")
def fit_width_slices(spark, sf_dir):
    out = R.fit_width_slices(V.images(spark, sf_dir), 700, 1000)
    return out.select("doc_id", "page_index", F.col("slice").cast("long").alias("slice"), "top", "rows")


@query(f"""{V.duck('v_images', s="SELECT *, least(CAST(700 AS FLOAT) / CAST(width AS FLOAT), CAST(1000 AS FLOAT) / CAST(height AS FLOAT)) AS scale FROM v_images")}SELECT doc_id, page_index, w AS box_width, h AS box_height, 20 + (700 - w) // 2 AS box_x, 20 + (1000 - h) // 2 AS box_y FROM (
 SELECT doc_id, page_index, greatest(CAST(floor(CAST(CAST(width AS FLOAT) * scale AS DOUBLE) + 0.5) AS BIGINT), 1) AS w, greatest(CAST(floor(CAST(CAST(height AS FLOAT) * scale AS DOUBLE) + 0.5) AS BIGINT), 1) AS h FROM s)""")
def fit_page_box(spark, sf_dir):
    return R.fit_page_box(V.images(spark, sf_dir), 700, 1000, 20).select("doc_id", "page_index", "box_width", "box_height", "box_x", "box_y")


# images, budgets, reports --------------------------------------------------------------------------

_RECOVER = f"""SELECT *, CASE WHEN px NOT BETWEEN 4096 AND 32000000 OR (px > 4000000 AND NOT visual_page) THEN 'skip' WHEN px > 4000000 THEN 'downsample' ELSE 'keep' END AS action FROM (
 SELECT *, width * height AS px, image_only AND {D.overlap(('0', '0', '612', '792'), ('bx', 'by_', 'bw', 'bh'))} >= 0.75 AS visual_page FROM v_images)"""


@query(f"""{V.duck('v_images', r=_RECOVER)}SELECT doc_id, page_index, image_index, action, visual_page, CASE action WHEN 'keep' THEN width WHEN 'downsample' THEN w END AS out_width,
 CASE action WHEN 'keep' THEN height WHEN 'downsample' THEN least(greatest(CAST(floor(height * sqrt(4000000 / px)) AS BIGINT), 1), 4000000 // w) END AS out_height FROM (SELECT *, greatest(CAST(floor(width * sqrt(4000000 / px)) AS BIGINT), 1) AS w FROM r)""")
def image_recovery(spark, sf_dir):
    return P.image_recovery(V.images(spark, sf_dir)).select("doc_id", "page_index", "image_index", "action", "visual_page", "out_width", "out_height")


@query(f"""{V.duck('v_images', r=_RECOVER)}SELECT doc_id, page_index, image_index, CAST(p AS BIGINT) AS page_total, CAST(d AS BIGINT) AS doc_total, CASE WHEN p > 8000000 THEN 'page' WHEN d > 9000000 THEN 'document' END AS failed FROM (
 SELECT *, sum(px) OVER (PARTITION BY doc_id, page_index ORDER BY image_index) AS p, sum(px) OVER (PARTITION BY doc_id ORDER BY page_index, image_index) AS d FROM r WHERE action <> 'skip')""")
def image_budget(spark, sf_dir):
    return P.image_budget(P.image_recovery(V.images(spark, sf_dir)), 8_000_000, 9_000_000).select("doc_id", "page_index", "image_index", "page_total", "doc_total", "failed")


def _chapters(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return docs.selectExpr("source", "doc_id as number", "text as html", "concat('Page ', doc_id) as title", "cast(octet_length(text) + 600 as long) as xhtml_bytes", "0L as image_markup", "cast(n_chars % 90000 as long) as asset_bytes", "cast(doc_id % 3 as long) as n_assets")


@query("""SELECT source, number FROM (SELECT *, max(CASE WHEN rn > 40 OR used + strlen(text) + 6 * strlen('Page ' || number) + 1024 > 131072 OR used + xb > 131072 OR ab > 2000000 OR na > 48 THEN 1 ELSE 0 END)
 OVER (PARTITION BY source ORDER BY number) AS stop FROM (SELECT source, doc_id AS number, text, strlen(text) + 600 AS xb, row_number() OVER w AS rn, coalesce(sum(strlen(text) + 600) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
 sum(n_chars % 90000) OVER w AS ab, sum(doc_id % 3) OVER w AS na FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))) WHERE stop = 0""")
def preview_prefix(spark, sf_dir):
    limits = P.PreviewLimits(40, 131_072, 2_000_000, 48)
    return P.preview_prefix(_chapters(spark, sf_dir), ["source"], limits).select("source", "number")


@query("""SELECT source, number, CAST(total AS BIGINT) AS total, CASE WHEN total <= 200000 THEN 'ok' WHEN total - a <= 200000 THEN 'over' ELSE 'after' END AS status FROM (SELECT source, doc_id AS number, strlen(text) + 600 AS a, sum(strlen(text) + 600) OVER (PARTITION BY source ORDER BY doc_id) AS total FROM documents)""")
def semantic_budget(spark, sf_dir):
    return P.running_budget(_chapters(spark, sf_dir), ["source"], ["number"], F.col("xhtml_bytes"), 200_000).select("source", "number", "total", "status")


_SEQ_WARN = "CASE {0} % 7 WHEN 0 THEN 'Page has no reliable text layer' WHEN 1 THEN 'Image skipped: memory limit' WHEN 2 THEN '  figures kept as images ' WHEN 3 THEN 'A font could not be read' WHEN 4 THEN text WHEN 5 THEN ' ' ELSE 'noted' END"


def _duck_group(x: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({x}, '(?i){pattern}') THEN '{name}'" for name, pattern in P.WARNING_GROUPS)
    return f"CASE {cases} ELSE '{P.OTHER_WARNINGS}' END"


@query(f"""SELECT source, {_duck_group('t')} AS "group", count(*) AS n, min(doc_id) AS first_seq FROM (SELECT source, doc_id, CASE WHEN length(t) > 800 THEN substr(t, 1, 797) || '…' ELSE t END AS t FROM (
 SELECT source, doc_id, {D.trim('w')} AS t FROM (SELECT source, doc_id, {_SEQ_WARN.format('doc_id')} AS w FROM documents)) WHERE t <> '') GROUP BY ALL""")
def warning_groups(spark, sf_dir):
    rows = _docs(spark, sf_dir).selectExpr("source", "doc_id as seq", f"{_SEQ_WARN.format('doc_id')} as text")
    return P.warning_groups(rows, ["source"])


@query(f"""{V.duck('v_spans', p="SELECT doc_id, page_index + 1 AS number, sum(" + _SOLID + ") >= 1500 AS has_text, count(*) FILTER (font_size = 12) AS n_images FROM v_spans GROUP BY ALL")}
SELECT doc_id, count(*) AS source_pages, count(*) FILTER (has_text) AS text_pages, CAST(sum(n_images) AS BIGINT) AS image_count, count(*) FILTER (NOT has_text) + CASE WHEN bool_or(has_text) THEN 0 ELSE 1 END AS n_warnings FROM p GROUP BY doc_id""")
def document_report(spark, sf_dir):
    pages = V.spans(spark, sf_dir).groupBy("doc_id", (F.col("page_index") + 1).alias("number")).agg((F.sum(S.solid()) >= 1500).alias("has_text"), F.count_if(F.col("font_size") == 12).alias("n_images"))
    return P.document_report(pages, ["doc_id"])


@query("""SELECT page_id, CASE WHEN NOT (mime = 'application/pdf' OR lower(url) LIKE '%.pdf') THEN 'not a PDF' WHEN size = 0 THEN 'empty' WHEN size > 4000 THEN 'too large' END AS problem,
 CASE WHEN size < 1024 THEN size || ' B' ELSE printf('%.1f', round(size / 1024, 1)) || ' KiB' END AS shown, substr(regexp_replace(url, '[^A-Za-z0-9_.-]', '', 'g'), 1, 64) AS token, greatest(CAST(floor((size + 48) / (400 + 48) + 0.5) AS BIGINT), 1) AS screens
FROM (SELECT page_id, url, strlen(html) AS size, CASE WHEN page_id % 4 = 0 THEN 'text/html' ELSE 'application/pdf' END AS mime FROM pages)""")
def file_checks(spark, sf_dir):
    files = _pages(spark, sf_dir).selectExpr("page_id", "url as name", "cast(octet_length(html) as long) as size", "case when page_id % 4 = 0 then 'text/html' else 'application/pdf' end as mime")
    return P.validate_files(files, 4000).select("page_id", "problem", T.format_bytes(F.col("size")).alias("shown"), T.diagnostic_token(F.col("name")).alias("token"), P.reader_pages(F.col("size"), F.lit(400)).alias("screens"))


@query("""SELECT page_id, i - 1 AS k, regexp_replace(regexp_replace(a[i], '[?#].*$', ''), '^(\\.\\./)+', '') AS href, EXISTS (FROM pages p WHERE p.url = regexp_replace(regexp_replace(a[i], '[?#].*$', ''), '^(\\.\\./)+', '')) AS found
FROM (SELECT page_id, regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1) a FROM pages), unnest(range(1, len(a) + 1)) t(i)""")
def asset_lookup(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), F.lit(1))
    links = _pages(spark, sf_dir).select("page_id", F.posexplode(found).alias("k", "src")).withColumn("k", F.col("k").cast("long"))
    return P.resolve_assets(links, _pages(spark, sf_dir).select(F.col("url").alias("href")).distinct()).select("page_id", "k", "href", "found")


# operators that read a page in order: checked by brute force and by hand-made cases in the tests ------

def _span_pages(spark, sf_dir):
    return _equation_spans(spark, sf_dir)


@query()
def title_reconstruct(spark, sf_dir):
    return Q.titles(V.spans(spark, sf_dir))


@query()
def centre_components(spark, sf_dir):
    return Q.page_components(V.spans(spark, sf_dir))


@query()
def run_in_headings(spark, sf_dir):
    return Q.page_run_in_headings(_span_pages(spark, sf_dir))


@query()
def split_headings(spark, sf_dir):
    return Q.page_split_headings(V.spans(spark, sf_dir))


@query()
def unnumbered_equations(spark, sf_dir):
    return Q.page_equations(_span_pages(spark, sf_dir))


@query()
def graphic_components(spark, sf_dir):
    return Q.page_graphics(V.spans(spark, sf_dir))


@query()
def visual_regions(spark, sf_dir):
    return Q.page_regions(V.spans(spark, sf_dir))


@query()
def markdown_xhtml(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", M.as_column(markdown_to_xhtml)(F.col("text")).alias("xhtml"))


@query()
def algorithm_blocks(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", M.as_column(M.algorithm_blocks)(F.col("html")).alias("html"))


@query()
def promoted_headings(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", M.as_column(M.promote_run_in_headings)(F.col("html")).alias("html"))


@query()
def demoted_headings(spark, sf_dir):
    demote = M.as_column(lambda html, text: M.demote_heading(html, 1, text))
    return _pages(spark, sf_dir).select("page_id", demote(F.col("html"), F.coalesce(T.first_heading(F.col("html")), F.lit(""))).alias("html"))


@query()
def language_tags(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", M.as_column(M.language_or_default)(F.col("lang")).alias("tag"))


@query()
def sanitized_previews(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", M.as_column(lambda html: M.sanitize_preview(html, {}))(F.col("html")).alias("html"))


DEVICE = C.Options(width=360, height=480, margin=12, dpi=120, font_size=6.0, max_pixels=512_000_000)


@query()
def reflow_pages(spark, sf_dir):
    return C.compose_digests(V.runs(spark, sf_dir), DEVICE)


@query()
def raster_documents(spark, sf_dir):
    documents = archive.package_runs(V.runs(spark, sf_dir), replace(DEVICE, mode=C.FIT_WIDTH))
    return documents.select("doc_id", "output_pages", F.length("content").alias("n_bytes"), "error")


@query()
def package_books(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    html = M.as_column(markdown_to_xhtml)(F.coalesce("text", F.lit("")))
    pages = docs.withColumn("html", html).select(
        "doc_id", F.lit(1).alias("number"), F.coalesce(T.first_heading(F.col("html")), F.lit("Page 1")).alias("title"), "html", T.has_text(F.col("html")).alias("has_text"))
    return archive.package_books(pages).select("doc_id", "source_pages", "text_pages", F.length("content").alias("n_bytes"), "error")


@query(f"""{V.duck('v_spans', 'v_images')}SELECT doc_id, page_index, region_index, l AS "left", t AS top, w AS crop_width, h AS crop_height, CASE WHEN w < 80 OR h < 48 THEN 'too-small' ELSE 'ok' END AS status FROM (
 SELECT doc_id, page_index, image_index AS region_index, CAST(greatest(floor(bx * 2), 0) AS BIGINT) AS l, CAST(greatest(floor((792 - by_ - bh) * 2), 0) AS BIGINT) AS t,
  least(CAST(ceil((bx + bw) * 2) AS BIGINT), 1224) - CAST(greatest(floor(bx * 2), 0) AS BIGINT) AS w, least(CAST(ceil((792 - by_) * 2) AS BIGINT), 1584) - CAST(greatest(floor((792 - by_ - bh) * 2), 0) AS BIGINT) AS h FROM v_images)""")
def crop_plans(spark, sf_dir):
    plan = X.crop_plan(V.image_regions(spark, sf_dir), "figure")
    return plan.select("doc_id", "page_index", "region_index", "left", "top", "crop_width", "crop_height", "status")
