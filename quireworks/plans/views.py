"""Layout relations derived from the tables ``documents`` and ``pages``, for Spark and for DuckDB.

Every view covers its whole table.  All geometry is integral, so single and
double precision agree.

* ``v_lines``: paragraph lines of the documents.
* ``v_spans``: five-word segments on two-column pages of 100 segments, with a
  running header; every 23rd is a bold heading, every 17th in a math font.
* ``v_images``: one image a page; one document in five is a scan.
* ``v_runs``: a raster of the words, twelve to a line in two columns, as ink runs.
* ``v_blocks``: paragraphs and headings of the pages' markup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no").cast("long"))


def _words() -> F.Column:
    return F.filter(F.split("text", "[ \\n]+"), lambda w: w != "")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", _words().alias("w")).filter("size(w) > 0")
    docs = docs.select("doc_id", "source", "w", F.explode(F.expr("sequence(0, (size(w) - 1) div 5)")).alias("k"))
    return docs.select("doc_id", "source", F.col("k").cast("long").alias("k"), F.expr("array_join(slice(w, cast(5 * k + 1 as int), 5), ' ')").alias("text"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    size = "case when (k % 100) < 2 then 16 when k % 23 = 0 then 12 else 10 end"
    body = seg.selectExpr(
        "doc_id", "k div 100 as page_index", "k % 100 as span_index", "text", "cast(case when k % 2 = 0 then 54 else 318 end as float) x",
        "cast(720 - 14 * ((k % 100) div 2) as float) y", "cast(least(length(text) * 5, 246) as float) width", f"cast({size} as float) height", f"cast({size} as float) font_size",
        "case when k % 23 = 0 then 'Heading' when k % 17 = 0 then 'CMMI10' else 'Body' end font_name", "case when k % 23 = 0 then 700 else 400 end font_weight")
    head = seg.selectExpr("doc_id", "source", "k div 100 as p").distinct().selectExpr(
        "doc_id", "p as page_index", "100L as span_index", "concat(source, ' report ', p) as text", "cast(54 as float) x", "cast(756 as float) y", "cast(80 as float) width",
        "cast(10 as float) height", "cast(10 as float) font_size", "'Body' font_name", "400 font_weight")
    return body.unionByName(head)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).select("doc_id", "page_index").distinct().selectExpr(
        "doc_id", "page_index", "0L as image_index", "64 * (1 + (doc_id * 7 + page_index * 3) % 60) as width", "64 * (1 + (doc_id * 5 + page_index) % 50) as height",
        "cast(case when doc_id % 5 = 0 then 0 else 54 end as float) bx", "cast(case when doc_id % 5 = 0 then 0 else 100 + (doc_id % 10) * 40 end as float) by_",
        "cast(case when doc_id % 5 = 0 then 612 else 248 end as float) bw", "cast(case when doc_id % 5 = 0 then 792 else 80 end as float) bh", "doc_id % 5 = 0 as image_only")


def image_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images as regions: keys, ``region_index`` and a rectangle."""
    return images(spark, sf_dir).selectExpr("doc_id", "page_index", "image_index as region_index", "bx as x", "by_ as y", "bw as width", "bh as height")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts are dealt out by document once; the window and what groups runs by document need no further exchange.
    # The number of parts is given, as texts are few bytes for the work that follows.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").repartition(parts, "doc_id")
    words = docs.select("doc_id", F.posexplode(_words()).alias("k", "word"))
    words = words.selectExpr("doc_id", "cast(k div 12 as long) as line", "(k % 12) div 6 as half", "k % 6 as slot", "cast(length(word) as long) as n")
    before = F.sum(F.col("n") + 1).over(Window.partitionBy("doc_id", "line", "half").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    words = words.withColumn("x0", F.col("half") * 160 + F.coalesce(before, F.lit(0)))
    words = words.selectExpr("doc_id", "4 * line + 12 * (line div 5) as top", "x0", "x0 + n as x1")
    return words.selectExpr("doc_id", "0L as page_index", "explode(array(top, top + 1)) as y", "x0", "x1")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = F.regexp_extract_all("html", F.lit(r"(?s)<(?:h[1-6]|p)>.*?</(?:h[1-6]|p)>"), F.lit(0))
    return pages.select("page_id", F.posexplode(found).alias("block_no", "markup")).select(
        "page_id", F.col("block_no").cast("long").alias("block_no"), F.regexp_extract("markup", "^<(h[1-6]|p)>", 1).alias("tag"), "markup")


#: The same views for DuckDB, in the order in which they build on each other.
DUCK = {
    "v_lines": "SELECT doc_id, i - 1 AS line_no, a[i] AS text, lang, source FROM (SELECT *, string_split(text, chr(10)) a FROM documents), unnest(range(1, len(a) + 1)) t(i)",
    "v_segments": """SELECT doc_id, source, k, array_to_string(w[5 * k + 1 : 5 * k + 5], ' ') AS text
FROM (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') w FROM documents), unnest(range(0, (len(w) - 1) // 5 + 1)) t(k) WHERE len(w) > 0""",
    "v_spans": """SELECT doc_id, k // 100 AS page_index, k % 100 AS span_index, text, CAST(CASE WHEN k % 2 = 0 THEN 54 ELSE 318 END AS FLOAT) x,
 CAST(720 - 14 * ((k % 100) // 2) AS FLOAT) y, CAST(least(length(text) * 5, 246) AS FLOAT) width,
 CAST(CASE WHEN (k % 100) < 2 THEN 16 WHEN k % 23 = 0 THEN 12 ELSE 10 END AS FLOAT) height, CAST(CASE WHEN (k % 100) < 2 THEN 16 WHEN k % 23 = 0 THEN 12 ELSE 10 END AS FLOAT) font_size,
 CASE WHEN k % 23 = 0 THEN 'Heading' WHEN k % 17 = 0 THEN 'CMMI10' ELSE 'Body' END font_name, CASE WHEN k % 23 = 0 THEN 700 ELSE 400 END font_weight FROM v_segments
UNION ALL SELECT doc_id, p, 100, concat(source, ' report ', p), CAST(54 AS FLOAT), CAST(756 AS FLOAT), CAST(80 AS FLOAT), CAST(10 AS FLOAT), CAST(10 AS FLOAT), 'Body', 400
FROM (SELECT DISTINCT doc_id, source, k // 100 p FROM v_segments)""",
    "v_images": """SELECT doc_id, page_index, 0 AS image_index, 64 * (1 + (doc_id * 7 + page_index * 3) % 60) width, 64 * (1 + (doc_id * 5 + page_index) % 50) height,
 CAST(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 54 END AS FLOAT) bx, CAST(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 100 + (doc_id % 10) * 40 END AS FLOAT) by_,
 CAST(CASE WHEN doc_id % 5 = 0 THEN 612 ELSE 248 END AS FLOAT) bw, CAST(CASE WHEN doc_id % 5 = 0 THEN 792 ELSE 80 END AS FLOAT) bh, doc_id % 5 = 0 AS image_only
FROM (SELECT DISTINCT doc_id, page_index FROM v_spans)""",
    "v_runs": """SELECT doc_id, 0 AS page_index, 4 * line + 12 * (line // 5) + r AS y, x0, x0 + n AS x1 FROM (
 SELECT doc_id, line, n, 160 * half + coalesce(sum(n + 1) OVER (PARTITION BY doc_id, line, half ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x0 FROM (
  SELECT doc_id, (i - 1) // 12 AS line, ((i - 1) % 12) // 6 AS half, (i - 1) % 6 AS slot, length(w[i]) AS n
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') w FROM documents), unnest(range(1, len(w) + 1)) t(i))), (VALUES (0), (1)) v(r)""",
    "v_blocks": """SELECT page_id, i - 1 AS block_no, regexp_extract(a[i], '^<(h[1-6]|p)>', 1) tag, a[i] AS markup
FROM (SELECT page_id, regexp_extract_all(html, '(?s)<(?:h[1-6]|p)>.*?</(?:h[1-6]|p)>', 0) a FROM pages), unnest(range(1, len(a) + 1)) t(i)""",
}
NEEDS = {"v_spans": ["v_segments"], "v_images": ["v_segments", "v_spans"]}


def duck(*names: str, **more: str) -> str:
    """A WITH clause of the named views, what they need, and ``more`` common tables."""
    wanted: list[str] = []
    for name in names:
        for need in [*NEEDS.get(name, []), name]:
            if need not in wanted:
                wanted.append(need)
    parts = [f"{n} AS ({DUCK[n]})" for n in wanted] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"
