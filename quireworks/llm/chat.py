"""Chat formatting of reply trees.

``branch_paths`` enumerates root-to-leaf paths by iterative self-joins whose
reach doubles: after round k a message knows its ancestor 2^k steps up, so the
number of joins follows the logarithm of the longest thread.  Branches are
ranked by score, and the ancestors of each chosen leaf are collected by the
saved jump tables, largest first.  ``format_paths`` writes each chosen path as
one conversation.  DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """No ``<|`` is left: ``<``, any backslashes, ``|`` gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role is one line: percent signs and line feeds are written as %25 and %0A."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def chain(turns: DataFrame) -> DataFrame:
    """Messages of plain conversations (conv_id, turn, role, text): each turn replies to the one before.

    Rows are ordered by turn, then role and text; null turns come first.  Null
    roles and texts count as empty.  Repeated rows are turns of their own.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # texts take no part in the sort but where turns tie
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = rows.withColumn("node_id", at)
    return rows.select("conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), F.lit(0.0).alias("score"), "role", "text")


def branch_paths(messages: DataFrame, top_k: int = 1) -> DataFrame:
    """``conv_id, leaf_id, rank, score, node_id, depth`` for the messages of each chosen branch.

    ``messages``: conv_id, node_id, parent_id, score (other columns are ignored).
    A branch scores the sum of its messages' scores (null: 0); the ``top_k``
    best leaves of each conversation are chosen, ties by the smaller node_id.
    A parent that is not there makes its message a root.  Messages on a cycle
    have no leaf and are left out.  node_id must be unique in a conversation and not null.
    """
    ws = Workspace(messages.sparkSession, "paths")
    base = messages.select("conv_id", "node_id", "parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("own"))
    parent = base.select(F.col("conv_id").alias("c"), F.col("node_id").alias("p"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    state = ws.save(base.join(parent, same("conv_id", "c") & (F.col("parent_id") == F.col("p")), "left").select(
        "conv_id", "node_id", F.col("p").alias("up"), F.lit(1).cast("long").alias("steps"), F.col("own").alias("sum")), "step0")
    jumps, most = [], state.count().bit_length() + 1
    leaves = ws.save(state.join(
        state.filter("up is not null").select(F.col("conv_id").alias("c"), F.col("up").alias("u")).distinct(),
        same("conv_id", "c") & (F.col("node_id") == F.col("u")), "left_anti").select("conv_id", "node_id"), "leaves")
    settled = []
    while len(jumps) < most:
        # conversations whose messages all know their root leave; the rounds go on for the longer ones alone
        open_ = state.filter("up is not null").select(F.col("conv_id").alias("c")).distinct()
        if open_.isEmpty():
            break
        open_ = ws.save(open_, f"open{len(jumps)}")
        settled.append(ws.save(state.join(open_, same("conv_id", "c"), "left_anti").filter("up is null"), f"settled{len(jumps)}"))
        state = ws.save(state.join(open_, same("conv_id", "c"), "left_semi"), f"left{len(jumps)}")
        jumps.append(state.filter("up is not null").select("conv_id", "node_id", "up"))
        above = state.select(F.col("conv_id").alias("c"), F.col("node_id").alias("a"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("sum").alias("sum2"))
        state = ws.save(state.join(above, same("conv_id", "c") & (F.col("up") == F.col("a")), "left").select(
            "conv_id", "node_id", F.col("up2").alias("up"),
            (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), (F.col("sum") + F.coalesce("sum2", F.lit(0.0))).alias("sum")), f"step{len(jumps)}")
    depth = reduce(DataFrame.unionByName, [*settled, state]).filter("up is null").select("conv_id", "node_id", F.col("steps").alias("depth"), F.col("sum").alias("score"))
    tips = depth.join(leaves.select(F.col("conv_id").alias("c"), F.col("node_id").alias("l")), same("conv_id", "c") & (F.col("node_id") == F.col("l"))).drop("c", "l")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "node_id"))
    tips = tips.withColumn("rank", rank).filter(F.col("rank") <= top_k)
    path = tips.select("conv_id", F.col("node_id").alias("leaf_id"), "rank", "score", "node_id", "depth")
    for k in range(len(jumps) - 1, -1, -1):
        jump = jumps[k].select(F.col("conv_id").alias("c"), F.col("node_id").alias("j"), "up")
        more = path.join(jump, same("conv_id", "c") & (F.col("node_id") == F.col("j"))).select(
            "conv_id", "leaf_id", "rank", "score", F.col("up").alias("node_id"), (F.col("depth") - 2**k).alias("depth"))
        path = path.unionByName(more)
        if k % 4 == 0:
            path = ws.save(path, f"path{k}")
    return path


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """``conv_id, leaf_id, rank, formatted, loss_spans``: one row per chosen path.

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  ``loss_spans`` (start from
    0, length, in characters of ``formatted``) mark what carries loss: each
    assistant text and nothing else.  A conversation is one value, so one task
    joins its turns.
    """
    rows = paths.select(F.col("conv_id").alias("c"), "leaf_id", "rank", F.col("node_id").alias("n"), "depth")
    rows = rows.join(messages.select("conv_id", "node_id", "role", "text"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node_id") == F.col("n")))
    turn = F.struct("depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id", "leaf_id", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    opened = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    out = turns.select("conv_id", "leaf_id", "rank", opened.alias("opened"))
    formatted = F.array_join(F.transform("opened", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    # one pass along the turns: where each begins, and a span for each assistant text
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END) + 1).alias("at"),
        F.when(t["loss"], F.array_append(acc["spans"], F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length")))).otherwise(acc["spans"]).alias("spans"))
    return out.select("conv_id", "leaf_id", "rank", formatted.alias("formatted"), F.aggregate("opened", zero, step, lambda acc: acc["spans"]).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    cut = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, F.lit(1 << 30))
    def turn(piece):
        role = F.substring_index(piece, "\n", 1)
        text = F.substr(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END + "\n"))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))
    return F.transform(cut, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text of a formatted conversation under its loss spans, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
