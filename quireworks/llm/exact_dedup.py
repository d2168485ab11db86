"""Exact deduplication by distributed most-significant-digit radix partitioning.

Documents are compared as byte strings that start with their length.  Each
round splits the groups that are left by the next ``width`` bytes; a group of
one leaves at once, and a group whose documents have ended is a class of equal
texts.  No digest decides equality.  Digits widen from round to round, so the
number of rounds follows the logarithm of the longest repeated text.

A round counts its digits with a partial aggregation (a hot group sends one
row per task) and hands the counts back by an equi-join, which adaptive
execution splits where a group is hot.  Texts leave the data flow as soon as
their group is settled; those whose first digit a bitmap shows to be alone
never enter a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, mark_possible, text_bytes

FIRST_WIDTH, GROWTH = 64, 8


def exact_classes(docs: DataFrame, carry: list[Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, keep_id, group_size, kept`` and ``carry``.

    * The row with the largest identifier of each class of equal texts stays.
    * Null texts count as empty, so they form one class with empty texts.
    * A null identifier is smaller than any other; a class of only null
      identifiers has a null ``keep_id``, and its rows are marked as kept.
    * Rows that repeat identifier and text all count in ``group_size`` and carry
      the same mark (``drop_copies`` lets one of them stay).
    * Columns of the input are left out unless ``carry`` names them, so names
      cannot clash; an empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "exact")
    extra = F.struct(*(carry or []), F.lit(0).alias("_"))
    state = docs.select(F.col(id_col).alias("id"), extra.alias("extra"), text_bytes(text_col).alias("b"))
    state = state.withColumn("n", F.octet_length("b"))
    keys, depth, width, parts, old = ["n"], 0, FIRST_WIDTH, [], None
    while True:
        now = state.withColumn("digit", F.substring("b", depth + 1, width))
        count = now.groupBy(*keys, "digit").agg(F.count(F.lit(1)).alias("size"), F.max("id").alias("g"))
        # written before it is used: the numbers of the groups must not change when a task runs again
        count = ws.save(count.filter("size > 1").withColumn("next", F.monotonically_increasing_id()), f"groups{depth}")
        if not depth:  # texts that are surely alone stay where they are
            now = mark_possible(now, count, [*keys, "digit"], "maybe")
            parts.append(now.filter("not maybe").select("id", "extra", F.lit(1).cast("long").alias("size"), F.col("id").alias("g")))
            now = now.filter("maybe").drop("maybe")
        joined = now.join(count, [*keys, "digit"], "left")
        ended = F.col("size").isNull() | (F.col("n") <= depth + width)
        joined = joined.select("id", "extra", "n", "size", "g", F.col("next").alias("group"), ended.alias("ended"), F.when(~ended, F.col("b")).alias("b"))
        joined = ws.save(joined, f"round{depth}")
        if depth:  # the first round's count is read again for the rows that stay aside
            ws.drop(count)
        parts.append(joined.filter("ended").select(
            "id", "extra", F.coalesce("size", F.lit(1)).cast("long").alias("size"),
            F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("g")).alias("g")))
        state, keys = joined.filter("not ended").select("id", "extra", "n", "b", "group"), ["group"]
        depth, width = depth + width, width * GROWTH
        if state.isEmpty():
            break
    out = reduce(DataFrame.unionByName, parts)
    return out.select(
        F.col("id").alias(id_col), F.col("g").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("g")).alias("kept"), "extra.*").drop("_")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` (``doc_id``, ``text``, ...) for one row of each class of equal texts.

    Of rows that repeat identifier and text, the smallest by the other columns stays
    (null and empty texts are one text; columns that have no order do not count).
    """
    found = exact_classes(docs, [F.struct(*docs.columns).alias("row")])
    # equal texts that share an identifier too: only classes of several rows are looked at again
    alone = found.filter("kept and group_size = 1").select("row.*")
    ordered = [F.col(f"row.`{f.name}`") for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    several = found.filter("kept and group_size > 1").groupBy(F.col("doc_id").alias("_id"), text_bytes("row.text").alias("_text"))
    return alone.unionByName(several.agg(F.min_by("row", F.struct(*ordered)).alias("row")).select("row.*"))
