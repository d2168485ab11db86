"""Suffix-array deduplication: bytes covered by repeated windows of ``threshold`` bytes.

The suffixes that start at anchors are put in order by most-significant-digit
passes, and only through the threshold.  An anchor is the position, within
each window, of the ``DIGIT``-byte string with the smallest rolling hash, so
equal windows have their anchor at the same place, and every window has one.

1. First digit: the DIGIT bytes at the anchor.  Anchors alone in their bucket
   leave; none of their windows repeats.
2. Second digit: the bytes that all windows of the anchor span.  Where a whole
   span repeats, all its windows do, and its copies are settled at once.
3. Spans that differ within a bucket are cut into blocks of BLOCK windows.  A
   block is settled if its span repeats or if the core that its windows share
   does not.
4. Last digit: the windows of the blocks left, one representative of each
   distinct block.  Groups of two or more are exactly the repeated windows.

Digits of many bytes name their bucket by a 128-bit hash (the first pass by 64
bits, where a collision only sends more to the later passes).  A pass counts
with partial aggregation, so a hot bucket sends one row per task and digit.

A second, longer threshold is looked for only inside the runs that the shorter
one covers: a repeated window consists of shorter windows that repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, Workspace, key_of, lean, mark_possible, matching, text_bytes

THRESHOLD, DIGIT, BLOCK = 400, 48, 24
#: Bytes of a passage of 50 words, at four letters and a space each.
PASSAGE = 50 * 5
#: Keeps seeds positive: no block lies so many blocks behind its anchor.
FAR = 1 << 20
#: Bytes of a text that one pass hashes at a time; windows do not stop at its edges.
STEP = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


class Anchors:
    """Finds the anchors of a text: (first window, last window, anchor, digit hash), all absolute."""

    def __init__(self, threshold: int, digit: int):
        self.threshold, self.digit = threshold, digit
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = 1 << int(n).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, BASE, np.uint64)]))
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, INVERSE, np.uint64)]))

    def __call__(self, text: bytes) -> Iterator[tuple[int, int, int, int]]:
        held = None  # an anchor whose windows may go on beyond the step's edge
        for at in range(0, max(0, len(text) - self.threshold + 1), STEP):
            lo, hi, pos, d1 = self.part(text[at : at + STEP + self.threshold - 1])
            for row in zip((lo + at).tolist(), (hi + at).tolist(), (pos + at).tolist(), d1.tolist(), strict=True):
                if held and held[2] == row[2]:
                    held = (held[0], *row[1:])
                    continue
                if held:
                    yield held
                held = row
        if held:
            yield held

    def part(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        k, n = self.digit, len(text)
        self.powers(n)
        with np.errstate(over="ignore"):
            sums = np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * self.up[:n])
            h = sums[k - 1 :].copy()
            h[1:] -= sums[: n - k]
            h *= self.down[: n - k + 1]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        # the smallest hash, the leftmost of equals: upper bits order, lower bits say where
        low = np.uint64((1 << 21) - 1)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width, have = self.threshold - k + 1, 1
        while have < width:
            step = min(have, width - have)
            m = np.minimum(m[:-step], m[step:])
            have += step
        pos = (m & low).astype(np.int64)
        first = np.flatnonzero(np.diff(pos, prepend=-1))
        last = np.append(first[1:] - 1, len(pos) - 1)
        return first, last, pos[first], h[pos[first]].view(np.int64)


ANCHOR = "k long, h long, lo long, hi long, pos long, d1 long, d2 binary"
BLOCKS = "k long, h long, lo long, hi long, pos long, core long, span binary, done boolean"
WINDOWS = "k long, h long, lo long, w binary, open boolean"
#: Rows that a task gathers before it sends them on.
FLUSH = 20_000


def _frames(rows: Iterator[tuple], schema: str) -> Iterator[pd.DataFrame]:
    names, held = [c.split()[0] for c in schema.split(", ")], []
    for row in rows:
        held.append(row)
        if len(held) >= FLUSH:
            yield pd.DataFrame(held, columns=names)
            held = []
    yield pd.DataFrame(held, columns=names)


def _each(batches: Iterator[pd.DataFrame], *more: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(batch["k"].tolist(), batch["h"].tolist(), batch["b"], *(batch[c] for c in more), strict=True)


def find_anchors(docs: DataFrame, threshold: int, digit: int) -> DataFrame:
    """Anchors of all windows of ``docs`` (k, h, b), or of those inside its ``runs`` where it has that column."""
    inside = ["runs"] if "runs" in docs.columns else []

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        find = Anchors(threshold, digit)
        for k, h, text, *runs in _each(batches, *inside):
            for a, b in ((r["lo"], r["hi"]) for r in runs[0]) if inside else [(0, len(text))]:
                for lo, hi, pos, d1 in find(text[a:b]):
                    yield k, h, lo + a, hi + a, pos + a, d1, xxhash.xxh3_128_digest(text[lo + a : hi + a + threshold])

    return docs.select("k", "h", "b", *inside).mapInPandas(lean(lambda it: _frames(rows(it), ANCHOR)), ANCHOR)


def cut_blocks(texts: DataFrame, threshold: int) -> DataFrame:
    """Blocks of BLOCK windows, counted from the anchor so that equal ones meet."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        digest = xxhash.xxh3_128_digest
        for k, h, text, marks in _each(batches, "marks"):
            last = len(text) - threshold
            for mark in marks if marks is not None else ():
                lo, hi, pos, done = mark["lo"], mark["hi"], mark["pos"], mark["done"]
                for j in range((pos - hi) // BLOCK, (pos - lo) // BLOCK + 1):
                    b = pos - j * BLOCK
                    a = b - BLOCK + 1
                    # the text's edges may cut windows off; what is cut is part of the digit, and so is the
                    # distance to the anchor: blocks of two anchors may be one place of the text
                    x, y = max(a, 0), min(b, last)
                    core = xxhash.xxh3_64_intdigest(text[b : a + threshold], seed=j + FAR) - 2**63
                    span = digest(text[x : y + threshold], seed=((j + FAR) * BLOCK + x - a) * BLOCK + b - y)
                    yield k, h, max(a, lo), min(b, hi), pos, core, span, done

    return texts.filter("marks is not null").select("k", "h", "b", "marks").mapInPandas(lean(lambda it: _frames(rows(it), BLOCKS)), BLOCKS)


def cut_windows(texts: DataFrame, threshold: int) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for k, h, text, marks in _each(batches, "blocks"):
            for mark in marks:
                for x in range(mark["lo"], mark["hi"] + 1):
                    yield k, h, x, xxhash.xxh3_128_digest(text[x : x + threshold]), mark["open"]

    return texts.mapInPandas(lean(lambda it: _frames(rows(it), WINDOWS)), WINDOWS)


def _settle(rows: DataFrame, outer: str, inner: str, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Of a pass: digits ``inner`` that repeat, and one row of each digit of the ``outer`` buckets that hold several.

    ``n`` counts the digit's rows; a digit's one row is itself, with its ``done``.
    """
    groups = rows.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "h", "lo", "hi", "pos", "done")).alias("one"))
    groups = ws.save(groups, "groups")
    several = ws.save(groups.groupBy(outer).agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select(outer), "several")
    kinds = ws.save(matching(groups, several, [outer]).select("one.*", "n"), "kinds")
    whole = ws.save(groups.filter("n > 1").select(outer, inner), "whole")
    ws.drop(groups, several)
    return whole, kinds


def _shared(rows: DataFrame, digit: str, ws: Workspace) -> DataFrame:
    """Rows whose ``digit`` occurs more than once."""
    shared = ws.save(rows.groupBy(digit).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(digit), "shared")
    out = ws.save(matching(rows, shared, [digit]).select(rows.columns), "active")
    ws.drop(rows, shared)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """Adds keys that tell texts apart even where doc_id is null or repeats, and the text's bytes, under names of our own."""
    return docs.select("*", key_of().alias("_qw_k"), F.xxhash64(text_bytes()).alias("_qw_h"), text_bytes().alias("_qw_b"))


def bare(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_qw_k").alias("k"), F.col("_qw_h").alias("h"), F.col("_qw_b").alias("b"))


def repeated_spans(docs: DataFrame, ws: Workspace, threshold: int = THRESHOLD, digit: int = DIGIT) -> tuple[DataFrame, DataFrame]:
    """(spans, texts) of ``docs`` (k, h, b).

    spans: ``k, h, spans`` with the runs of windows (lo to hi) that repeat, for
    texts that have any.  texts: ``k, h, b`` of all texts in spans and some more.
    With a column ``runs`` (bytes lo to hi), only windows inside them count.
    """
    anchors = _shared(ws.save(find_anchors(docs, threshold, digit), "anchors"), "d1", ws).withColumn("done", F.lit(False))
    whole, kinds = _settle(anchors, "d1", "d2", ws)
    settled = ws.save(matching(anchors, whole, ["d1", "d2"]).select("k", "h", "lo", "hi"), "settled")
    marks = kinds.groupBy("k", "h").agg(F.collect_list(F.struct("lo", "hi", "pos", (F.col("n") > 1).alias("done"))).alias("marks"))
    docs = docs.select("k", "h", "b")
    need = ws.save(settled.select("k", "h").distinct().join(marks, ["k", "h"], "full"), "need")
    # texts pass one shuffle; those without a shared anchor do not
    maybe = mark_possible(docs, need, ["k", "h"], "maybe").filter("maybe").drop("maybe")
    texts = ws.save(maybe.join(need, ["k", "h"]), "texts")
    ws.drop(whole, kinds, need)
    blocks = _shared(ws.save(cut_blocks(texts, threshold), "blocks"), "core", ws)
    whole, kinds = _settle(blocks, "core", "span", ws)
    in_blocks = ws.save(matching(blocks.filter("not done"), whole, ["core", "span"]).select("k", "h", "lo", "hi"), "in-blocks")
    listed = kinds.groupBy("k", "h").agg(F.collect_list(F.struct("lo", "hi", ((F.col("n") == 1) & ~F.col("done")).alias("open"))).alias("blocks"))
    windows = ws.save(cut_windows(texts.select("k", "h", "b").join(listed, ["k", "h"]), threshold), "windows")
    ws.drop(blocks, whole, kinds)
    twice = ws.save(windows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w"), "twice")
    in_windows = matching(windows.filter("open"), twice, ["w"]).select("k", "h", "lo", F.col("lo").alias("hi"))
    # rows that repeat a key give their runs more than once
    runs = settled.unionByName(in_blocks).unionByName(in_windows)
    spans = ws.save(runs.groupBy("k", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    ws.drop(settled, in_blocks, windows, twice)
    bare_texts = texts.select("k", "h", "b")
    bare_texts.saved_path = texts.saved_path
    return spans, bare_texts


def merge(spans, threshold: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes of windows lo to hi."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"] + threshold) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


RUN_LIST = "array<struct<lo:long,hi:long>>"
RUNS = f"k long, h long, runs {RUN_LIST}"


def merged_runs(spans: DataFrame, threshold: int) -> DataFrame:
    """``k, h, runs``: the maximal runs of bytes that ``spans`` cover."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for k, h, found in zip(batch["k"].tolist(), batch["h"].tolist(), batch["spans"], strict=True):
                yield k, h, [{"lo": a, "hi": b} for a, b in merge(found, threshold)]

    return spans.mapInPandas(lean(lambda it: _frames(rows(it), RUNS)), RUNS)


def nested_spans(docs: DataFrame, ws: Workspace, threshold: int, passage: int, digit: int = DIGIT) -> DataFrame:
    """``k, h, spans, runs`` of ``docs`` (k, h, b): spans as in ``repeated_spans`` or null, runs of repeated passages.

    A window of ``threshold`` bytes repeats only inside runs of the shorter ``passage``; the rest is not looked at again.
    """
    if passage > threshold:
        raise ValueError("a passage must not be longer than the threshold")
    spans, texts = repeated_spans(docs, ws, passage, digit)
    runs = ws.save(merged_runs(spans, passage), "runs")
    ws.drop(spans)
    long = runs.select("k", "h", F.filter("runs", lambda r: r["hi"] - r["lo"] >= threshold).alias("runs")).filter(F.size("runs") > 0)
    inside = ws.save(texts.join(long, ["k", "h"]), "inside")
    ws.drop(texts)
    spans, texts = repeated_spans(inside, ws, threshold, digit)
    ws.drop(inside, texts)
    return ws.save(runs.join(spans, ["k", "h"], "left"), "nested")


def cut_out(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for lo, hi in runs:
        kept.append(text[at:lo])
        at = hi
    return b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, digit: int = DIGIT) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text`` (other columns kept).

    Every byte that a repeated window of ``threshold`` bytes covers goes, in all
    copies.  A null text stays null; bytes that no longer form UTF-8 at a cut
    inside a character are dropped from the text.
    """
    ws = Workspace(docs.sparkSession, "repeats")
    rows = keyed(docs)
    spans, _ = repeated_spans(bare(rows), ws, threshold, digit)
    spans = spans.select(F.col("k").alias("_qw_k"), F.col("h").alias("_qw_h"), F.col("spans").alias("_qw_spans"))
    schema = docs.schema

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [
                t if s is None else cut_out(t.encode(), merge(s, threshold)).decode("utf-8", "ignore")
                for t, s in zip(batch["text"], batch["_qw_spans"], strict=True)]
            yield batch.assign(text=text)[schema.names]

    # documents that surely have no span stay where they are; only the others are shuffled
    rows = mark_possible(rows.drop("_qw_b"), spans, ["_qw_k", "_qw_h"], "_qw_maybe")
    aside = rows.filter("not _qw_maybe").select(docs.columns)
    joined = rows.filter("_qw_maybe").join(spans, ["_qw_k", "_qw_h"], "left").select(*docs.columns, "_qw_spans")
    return aside.unionByName(joined.mapInPandas(lean(cut), schema))


def removal_report(docs: DataFrame, threshold: int = THRESHOLD, digit: int = DIGIT, passage: int | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, text``.

    ``text`` is what is left, without the bytes of characters that a cut parts.  A null text counts as empty and a null doc_id stays null; rows that repeat
    doc_id and text stand for texts of their own, and each has its row.

    With ``passage``, no longer than ``threshold``, two columns follow: ``n_passage_bytes``, covered by repeated windows
    of so many bytes, and ``passage_free_text``, what is left without those.
    """
    ws = Workspace(docs.sparkSession, "repeats")
    rows = bare(keyed(docs.select("doc_id", "text")))
    if passage is None:
        spans = repeated_spans(rows, ws, threshold, digit)[0].withColumn("runs", F.lit(None).cast(RUN_LIST))
    else:
        spans = nested_spans(rows, ws, threshold, passage, digit)
    spans = spans.select(F.col("k").alias("k2"), F.col("h").alias("h2"), "spans", "runs")
    out = "k long, n_bytes long, n_removed long, n_spans long, kept binary, text string"
    more = [] if passage is None else ["n_passage_bytes", "passage_free_text"]
    if more:
        out += ", n_passage_bytes long, passage_free_text string"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs = [merge(s, threshold) if s is not None else [] for s in batch["spans"]]
            kept = [cut_out(t, r) for t, r in zip(batch["b"], runs, strict=True)]
            size = [len(t) for t in batch["b"]]
            done = pd.DataFrame({
                "k": batch["k"], "n_bytes": size, "n_removed": [n - len(x) for n, x in zip(size, kept, strict=True)],
                "n_spans": [len(r) for r in runs], "kept": kept, "text": [x.decode("utf-8", "ignore") for x in kept]})
            if more:
                short = [[(r["lo"], r["hi"]) for r in found] if found is not None else [] for found in batch["runs"]]
                done["n_passage_bytes"] = [sum(b - a for a, b in found) for found in short]
                done["passage_free_text"] = [cut_out(t, r).decode("utf-8", "ignore") for t, r in zip(batch["b"], short, strict=True)]
            yield done

    # documents that surely have no span stay where they are
    rows = mark_possible(rows.withColumns({"k2": F.col("k"), "h2": F.col("h")}), spans, ["k2", "h2"], "maybe")
    hit = rows.filter("maybe").join(spans, ["k2", "h2"], "left").select("k", "b", "spans", "runs").mapInPandas(lean(cut), out)
    zero, whole = F.lit(0).cast("long"), F.col("b").cast("string")
    rest = rows.filter("not maybe").select("k", F.octet_length("b").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("b").alias("kept"), whole.alias("text"), *[c.alias(name) for c, name in zip([zero, whole], more, strict=False)])
    return rest.unionByName(hit).select(
        F.when(F.col("k") != F.lit(NULL_KEY), F.col("k")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "text", *more)
