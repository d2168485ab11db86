"""URL filters: rules first, then a character language-model ratio.

Two smoothed variable-order Markov models, one of accepted and one of rejected
urls, are fitted on urls that a rule decides.  A url's score is the difference
of its log-likelihoods over its length; it is allowed if the score reaches a
threshold calibrated on labelled urls that the models did not see.

Everything is DataFrame functions.  The models become one table of weights per
character n-gram: the difference of both models at a position is the sum of a
weight for each context and each n-gram that ends there, so scoring is a join
of exploded n-grams with that table.  All labelled urls count, so the table
grows with the input: its common n-grams are broadcast, the others are joined
by a shuffle of the positions that the common ones leave.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORDER = 4  # characters of context
ALPHABET = 128  # outcomes that the lowest order smooths over
STRENGTH = 2.0  # weight of the next lower order
#: N-grams that occur less often in the labelled urls are left to the lower order.
LEAST_COUNT = 3
#: N-grams that hold this share of the labelled positions are common: ORDER + 1 times its inverse at most.
COMMON_SHARE = 1 / 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + F.lit(3), F.length(url))
    there = at > 0
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(F.lit("")), F.when(there, path).otherwise(F.lit(""))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def grams(rows: DataFrame, keep: list[str], text: str = "url") -> DataFrame:
    """Every n-gram of one to ORDER + 1 characters of ``text``, which starts after ORDER marks ``\\n``."""
    rows = rows.withColumn("_t", F.concat(F.lit("\n" * ORDER), F.col(text))).filter(F.length(text) > 0)
    rows = rows.select(*keep, "_t", F.explode(F.sequence(F.lit(ORDER + 1), F.length("_t"))).alias("_i"))
    each = F.array(*[F.col("_t").substr(F.col("_i") - k, F.lit(k + 1)) for k in range(ORDER + 1)])
    return rows.select(*keep, F.explode(each).alias("gram"))


def fit_weights(labelled: DataFrame) -> DataFrame:
    """``gram, weight, common`` of the models of ``labelled`` (url, accepted boolean).

    P(c | context) = (n(context c) + STRENGTH * P(c | shorter context)) / (n(context) + STRENGTH).
    The order varies: the longest context whose n-gram was kept decides, and an
    n-gram that was not kept leaves the position to the next lower order.  The
    weight of an n-gram is what it adds to the log ratio of the order below.
    """
    counts = grams(labelled, ["accepted"]).groupBy("gram").agg(
        F.count_if("accepted").cast("double").alias("a"), F.count_if(~F.col("accepted")).cast("double").alias("r"))
    counts = counts.withColumn("k", F.length("gram")).filter((F.col("k") == 1) | (F.col("a") + F.col("r") >= LEAST_COUNT)).checkpoint()
    level = counts.filter("k = 1").withColumn("na", F.sum("a").over(Window.partitionBy("k"))).withColumn("nr", F.sum("r").over(Window.partitionBy("k")))
    level = level.select("gram", *[((F.col(c) + 0.5) / (F.col(f"n{c}") + 0.5 * ALPHABET)).alias(f"p{c}") for c in "ar"])
    level = level.withColumn("llr", F.log(F.col("pa") / F.col("pr")))
    parts = [level.select("gram", F.col("llr").alias("weight"))]
    positions = counts.filter("k = 1").agg((F.sum(F.col("a") + F.col("r")) * COMMON_SHARE).alias("_least"))
    common = counts.crossJoin(F.broadcast(positions)).select("gram", (F.col("a") + F.col("r") >= F.col("_least")).alias("common"))
    for k in range(2, ORDER + 2):
        now = counts.filter(F.col("k") == k).withColumn("context", F.substring("gram", 1, k - 1)).withColumn("suffix", F.substring("gram", 2, k))
        context = now.groupBy("context").agg(F.sum("a").alias("na"), F.sum("r").alias("nr"))
        lower = level.select(F.col("gram").alias("suffix"), F.col("pa").alias("qa"), F.col("pr").alias("qr"), F.col("llr").alias("below"))
        now = now.join(context, "context").join(lower, "suffix")
        level = now.select("gram", "below", *[((F.col(c) + STRENGTH * F.col(f"q{c}")) / (F.col(f"n{c}") + STRENGTH)).alias(f"p{c}") for c in "ar"])
        level = level.withColumn("llr", F.log(F.col("pa") / F.col("pr")))
        parts.append(level.select("gram", (F.col("llr") - F.col("below")).alias("weight")))
    return reduce(DataFrame.unionByName, parts).join(common, "gram")


def scores(urls: DataFrame, weights: DataFrame) -> DataFrame:
    """``url, score``: log-likelihood difference per character of distinct urls; an empty one has no row."""
    common = F.broadcast(weights.filter("common").select("gram", "weight"))  # bounded by COMMON_SHARE
    rare = weights.filter("not common").select("gram", "weight")
    each = grams(urls, ["url"])
    near = each.join(common, "gram").groupBy("url").agg(F.sum("weight").alias("total"))
    far = each.join(common.select("gram"), "gram", "left_anti").join(rare, "gram").groupBy("url").agg(F.sum("weight").alias("total"))
    found = near.unionByName(far).groupBy("url").agg(F.sum("total").alias("total"))
    return urls.filter("length(url) > 0").select("url").join(found, "url", "left").select(
        "url", (F.coalesce("total", F.lit(0.0)) / F.length("url")).alias("score"))


def distinct_labelled(labelled: DataFrame) -> DataFrame:
    """The distinct labelled urls with a hash ``_h`` that deals them to the models and the threshold."""
    return labelled.groupBy("url").agg(F.bool_or("accepted").alias("accepted")).withColumn("_h", F.xxhash64("url"))


def calibrate(scored: DataFrame) -> DataFrame:
    """One row ``threshold`` that separates the classes best: midway between two neighbouring scores.

    ``scored``: score, accepted.  Balanced accuracy decides, then the smaller
    score.  Without rows of both classes the threshold is null.  Scores are
    ordered in ranges, each of which goes on from the counts of those before it.
    """
    by = scored.groupBy("score").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    by = by.repartitionByRange("score").withColumn("_part", F.spark_partition_id()).checkpoint()
    whole, before = Window.partitionBy(), Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a range
    parts = by.groupBy("_part").agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.max("score").alias("last"))
    parts = parts.select(
        "_part", F.sum("a").over(whole).alias("na"), F.sum("r").over(whole).alias("nr"), F.coalesce(F.sum("a").over(before), F.lit(0)).alias("a0"),
        F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"), F.max("last").over(before).alias("last"))
    inside = Window.partitionBy("_part").orderBy("score")
    below = inside.rowsBetween(Window.unboundedPreceding, -1)
    at = by.join(F.broadcast(parts), "_part").select(
        ((F.col("score") + F.coalesce(F.lag("score").over(inside), F.col("last"), F.col("score"))) / 2).alias("score"),
        (1 - F.try_divide(F.col("a0") + F.coalesce(F.sum("a").over(below), F.lit(0)), F.col("na"))).alias("kept"),
        F.try_divide(F.col("r0") + F.coalesce(F.sum("r").over(below), F.lit(0)), F.col("nr")).alias("cut"))
    good = at.filter("kept is not null and cut is not null")
    return good.agg(F.max_by("score", F.struct(F.col("kept") + F.col("cut"), -F.col("score"))).alias("threshold"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages`` (page_id, url).

    A rule's verdict stands.  Else the url is allowed if its score reaches the
    threshold; if a class has no labelled url, or the url has no characters,
    it is allowed.  Rows that repeat a page_id are judged by their own url.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("ruled", verdict)
    labelled = base.filter("ruled is not null").select("url", (F.col("ruled") == "allow").alias("accepted"))
    # read several times, computed once
    fitted = distinct_labelled(labelled).checkpoint()
    train, held = fitted.filter("pmod(_h, 5) != 0"), fitted.filter("pmod(_h, 5) = 0")
    weights = fit_weights(train).checkpoint()
    threshold = calibrate(scores(held, weights).join(held, "url")).first()[0]
    # urls are scored once, whatever the number of pages that share them
    scored = scores(base.filter("ruled is null and url is not null").select("url").distinct(), weights)
    out = base.join(scored, "url", "left")
    method = F.when(F.col("score") < F.lit(threshold).cast("double"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score")
