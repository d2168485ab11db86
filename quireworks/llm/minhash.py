"""Near-duplicate classes by improved consistent weighted sampling (Ioffe, 2010).

A text is the weighted set of its five-word shingles; a shingle weighs its
frequency in the text times its inverse document frequency over all texts.
Document frequencies are exact for every shingle that at least the share FLOOR
of the texts hold; rarer ones weigh as if that share held them.  So at most
(shingles of an average text) / FLOOR numbers are ever gathered, whatever the
table's size, and a weight means the same at every size.

Each text has BANDS x ROWS consistent weighted samples of its own.  Texts that
share a band are candidates, and weighted Jaccard similarity of whole texts
decides.

Within a band's bucket no pairs are spelled out: members are compared with one
hub, and verified links join classes.  Where a bucket's members are left in
several classes, the members outside its largest class are joined with those of
all open buckets by prefix filtering, which is exact: in any one order of shingles,
what two texts share lies behind their first common shingle, so that shingle is
among the first of each, and what follows it weighs enough in both.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, Workspace, key_of, lean, mark_possible, matching, text_bytes
from .wordhash import WordHasher, mix, steps

SHINGLE, SIMILAR = 5, 0.8
#: At similarity 0.8 a pair shares a band with probability 1 - (1 - 0.8^4)^12 = 0.998.
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
#: Shingles that a smaller share of the texts hold weigh as if this share held them.
FLOOR = 0.001
#: Distinct shingles are counted in 2**SKETCH_BITS cells first, to tell which may reach FLOOR; sent in blocks of CELLS.
SKETCH_BITS, CELLS = 21, 4096
FLUSH = 1 << 21

_PUNCTUATION = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_WEIGHTS = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 2**64) | 1) for i in range(max(SHINGLE, ROWS))]
_M = np.uint64(0x94D049BB133111EB)


class Shingler:
    """Distinct shingle hashes of texts and how often each occurs.

    Words are lower-cased; ASCII punctuation and white space part them.  A text
    of fewer words than a shingle has one shingle of all of them; a text without
    words has none.
    """

    def __init__(self) -> None:
        self.words = WordHasher()

    @staticmethod
    def plain(text: bytes) -> bytes:
        text = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
        return text.translate(_PUNCTUATION)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingles, counts, number of distinct shingles of each text); shingles rise within a text."""
        a, n = self.words([self.plain(t) for t in texts])
        upto = np.cumsum(n)
        sizes = np.maximum(n - SHINGLE + 1, np.minimum(n, 1))
        ends = np.cumsum(sizes)
        h = np.zeros(int(sizes.sum()), np.uint64)
        with np.errstate(over="ignore"):
            if len(a) >= SHINGLE:
                m = len(a) - SHINGLE + 1
                rolled = a[:m] * _WEIGHTS[0]
                for i in range(1, SHINGLE):
                    rolled = rolled + a[i : m + i] * _WEIGHTS[i]
                rolled = mix(rolled)
            for size, end, last, words in zip(sizes.tolist(), ends.tolist(), upto.tolist(), n.tolist(), strict=True):
                if words >= SHINGLE:
                    part = h[end - size : end]
                    part[:] = rolled[last - words : last - words + size]
                    part.sort()
                elif words:
                    h[end - 1] = mix(sum(a[last - words + i : last - words + i + 1] * _WEIGHTS[i] for i in range(words)) + np.uint64(words))[0]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[(ends - sizes)[sizes > 0]] = True
        at = np.flatnonzero(new)
        return h[at], np.diff(at, append=len(h)), np.diff(np.searchsorted(at, ends), prepend=0)


def idf(share: np.ndarray) -> np.ndarray:
    """Inverse document frequencies between 1 (in every text) and 2 (in the share FLOOR of the texts or less)."""
    return 1 + np.log(np.maximum(share, FLOOR)) / np.log(FLOOR)


class Frequencies:
    """Exact document frequencies of the shingles that reach FLOOR, as weights; and the sketch's graded cells, for an order."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray, texts: int, cells: np.ndarray):
        order = np.argsort(shingles)
        self.shingles, self.factors = shingles[order], idf(counts[order] / max(texts, 1))
        self.cells = cells

    def weights(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return n * 2.0
        at = np.minimum(np.searchsorted(self.shingles, h), len(self.shingles) - 1)
        return n * np.where(self.shingles[at] == h, self.factors[at], 2.0)

    def cell(self, h: np.ndarray) -> np.ndarray:
        return self.cells[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]


def _gamma(u: np.ndarray) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution."""
    x = np.geomspace(1e-6, 60, 50_001)
    lower = np.where(x < 1e-3, x * x / 2 - x**3 / 3, 1 - (1 + x) * np.exp(-x))
    return np.interp(u, lower, x)


#: r and beta in 256 steps of equal probability each; 16 bits name both.
_R = np.repeat(_gamma((np.arange(256) + 0.5) / 256), 256)
_BETA = np.tile((np.arange(256) + 0.5) / 256, 256)
#: log(c) by the upper 17 bits of a 32-bit number as float: steps of 1/256 of the number, down to 2^-32.
_LOG_C = np.log(_gamma(np.clip((np.arange(160 << 8, dtype=np.int32) << 15).view(np.float32) * (1 + 2.0**-9) * 2.0**-32, 2.0**-33, 1 - 2.0**-10))).astype(np.float32)
_SEEDS = mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def _steps(log_weight: np.ndarray | float, rb: np.ndarray) -> np.ndarray:
    return np.floor(log_weight / _R[rb] + _BETA[rb])


def _lift(log_weight: np.ndarray | float, rb: np.ndarray) -> np.ndarray:
    return (_R[rb] * (_steps(log_weight, rb) - _BETA[rb] + 1)).astype(np.float32)


#: r (t - beta + 1) of the weight that most shingles have.
_PLAIN = _lift(np.log(2.0), np.arange(1 << 16))


def samples(h: np.ndarray, weight: np.ndarray, sizes: np.ndarray, number: int = SAMPLES) -> np.ndarray:
    """``number`` consistent weighted samples of each text, as 64-bit names; ``sizes`` shingles a text, 1 at least.

    Ioffe's scheme: r and c follow Gamma(2, 1), beta is uniform, all made from a
    shingle's hash; t = floor(log(weight) / r + beta), and the shingle of the
    smallest log(c) - r (t - beta + 1) is sampled with its t.
    """
    first = np.cumsum(sizes) - sizes
    other = np.flatnonzero(weight != 2.0)
    log_other = np.log(weight[other])
    out = np.zeros((len(sizes), number), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(number):
            x = h * _SEEDS[2 * j]
            x ^= x >> np.uint64(32)
            x *= _SEEDS[2 * j + 1]
            rb = x.view(np.uint16)[1::4].astype(np.intp)
            c = x.view(np.uint32)[1::2].astype(np.float32).view(np.int32)
            c >>= 15
            a = _LOG_C.take(c)
            lift = _PLAIN.take(rb)
            if len(other):
                lift[other] = _lift(log_other, rb[other])
            a -= lift
            hit = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first), sizes))
            hit = hit[np.searchsorted(hit, first)]  # the first of each text
            t = _steps(np.log(weight[hit]), rb[hit]).astype(np.int64).view(np.uint64)
            out[:, j] = mix(h[hit] + mix(t + np.uint64(j)))
    return out


def band_keys(names: np.ndarray) -> np.ndarray:
    """One key for each band of samples."""
    with np.errstate(over="ignore"):
        keys = np.zeros((len(names), BANDS), np.uint64)
        for i in range(ROWS):
            keys = mix(keys + names[:, i::ROWS] * _WEIGHTS[i])
        return keys + np.arange(1, BANDS + 1, dtype=np.uint64) * _M


def grade(counts: np.ndarray) -> np.ndarray:
    """Counts in steps of a sixth of a doubling, 0 for none: a byte up to 2^42."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1)) * 6) + 1, 0).astype(np.uint8)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingles, total, held, n, texts = Shingler(), np.zeros(1 << SKETCH_BITS, np.int32), [], 0, 0

    def add() -> None:
        nonlocal n
        if held:
            total[:] += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.int32)
        held.clear()
        n = 0

    for batch in batches:
        found = batch["b"].tolist()
        texts += len(found)
        for a, b in steps(found):
            cell = (shingles(found[a:b])[0] >> np.uint64(64 - SKETCH_BITS)).astype(np.int32)
            held.append(cell)
            n += len(cell)
            if n > FLUSH:
                add()
    add()
    rows = [(i, zlib.compress(part.tobytes(), 1)) for i, part in enumerate(total.reshape(-1, CELLS)) if part.any()]
    yield pd.DataFrame([*rows, (-1, str(texts).encode())], columns=["block", "cells"])


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    texts = 0
    for batch in batches:
        for block, cells in zip(batch["block"].tolist(), batch["cells"], strict=True):
            if block < 0:
                texts += int(cells)
            else:
                part = np.frombuffer(zlib.decompress(cells), np.int32)
                total[block] = total[block] + part if block in total else part.astype(np.int64)
    rows = [(i, zlib.compress(grade(part).tobytes(), 1)) for i, part in total.items()]
    yield pd.DataFrame([*rows, (-1, str(texts).encode())], columns=["block", "cells"])


def _common(shared):
    """Shingles in cells that may reach FLOOR, and how many texts hold each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, heavy, held, n = Shingler(), np.unpackbits(shared.value).astype(bool), [], 0

        def counted() -> pd.DataFrame:
            h, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pd.DataFrame({"h": h.view(np.int64), "n": count})

        for batch in batches:
            found = batch["b"].tolist()
            for a, b in steps(found):
                h = shingles(found[a:b])[0]
                held.append(h[heavy[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]])
                n += len(held[-1])
                if n > FLUSH:
                    yield counted()
                    n = 0
        if held:
            yield counted()

    return run


def frequencies(rows: DataFrame) -> Frequencies:
    """Document frequencies of the texts ``rows`` (b).

    The sketch never counts too little, so a shingle of the share FLOOR lies in
    a heavy cell; the shingles of heavy cells are then counted exactly.  The
    driver gets 2**SKETCH_BITS bytes and at most (shingles of an average text)
    / FLOOR shingles.
    """
    spark = rows.sparkSession
    parts = rows.mapInPandas(lean(_counted), "block int, cells binary")
    parts = parts.repartition(32, "block").mapInPandas(lean(_summed), "block int, cells binary")
    cells, texts = np.zeros(((1 << SKETCH_BITS) // CELLS, CELLS), np.uint8), 0
    for row in parts.collect():
        if row["block"] < 0:
            texts += int(row["cells"])
        else:
            cells[row["block"]] = np.frombuffer(zlib.decompress(row["cells"]), np.uint8)
    cells = cells.reshape(-1)
    least = max(1, int(np.ceil(FLOOR * texts)))
    heavy = cells >= grade(np.array([least]))[0]
    if not heavy.any():
        return Frequencies(np.zeros(0, np.uint64), np.zeros(0), texts, cells)
    shared = spark.sparkContext.broadcast(np.packbits(heavy))
    counts = rows.mapInPandas(lean(_common(shared)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    found = np.array([(r["h"], r["n"]) for r in counts.collect()], np.int64).reshape(-1, 2)
    shared.unpersist()
    return Frequencies(found[:, 0].copy().view(np.uint64), found[:, 1].astype(float), texts, cells)


def _signatures(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, known = Shingler(), shared.value
        for batch in batches:
            texts = batch["b"].tolist()
            for a, b in steps(texts):
                h, n, sizes = shingles(texts[a:b])
                weight, some = known.weights(h, n), sizes > 0
                keys = band_keys(samples(h, weight, sizes[some])).view(np.int64).tolist() if some.any() else []
                keys = iter(keys)
                part = batch.iloc[a:b]
                yield pd.DataFrame({
                    "k": part["k"].to_numpy(), "text_hash": part["text_hash"].to_numpy(), "bands": [next(keys) if s else [] for s in some],
                    "weight": np.bincount(np.repeat(np.arange(len(sizes)), sizes), weight, len(sizes))})

    return run


def _similar(shared, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, known = Shingler(), shared.value
        held: dict[bytes, tuple[np.ndarray, np.ndarray, float]] = {}

        def weighted(text: bytes) -> tuple[np.ndarray, np.ndarray, float]:
            if (found := held.get(text)) is None:
                h, n, _ = shingles([text])
                w = known.weights(h, n)
                if len(held) >= 64:
                    held.clear()
                found = held[text] = h, w, w.sum()
            return found

        for batch in batches:
            out = np.zeros(len(batch))
            for i, (x, y) in enumerate(zip(batch["x"], batch["y"], strict=True)):
                (h, w, hw), (g, v, gv) = weighted(x), weighted(y)
                at = np.searchsorted(h, g)
                at[at == len(h)] = 0
                same = h[at] == g if len(h) else np.zeros(len(g), bool)
                both = np.minimum(w[at[same]], v[same]).sum()
                out[i] = both / max(hw + gv - both, 1e-300)
            keep = out >= least
            yield pd.DataFrame({"a": batch["a"][keep], "b": batch["b"][keep], "similarity": out[keep]})

    return run


def _prefixes(shared, least: float):
    """The first shingles of each text by (cell of the sketch, hash), until the rest weighs under ``least`` of the text.

    ``tail`` is the weight of a shingle and all that follow it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, known = Shingler(), shared.value
        for batch in batches:
            texts = batch["b"].tolist()
            for a, b in steps(texts):
                h, n, sizes = shingles(texts[a:b])
                weight, owner = known.weights(h, n), np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((h, known.cell(h), owner))
                before = np.cumsum(weight[order]) - weight[order]
                first = np.cumsum(sizes) - sizes
                before -= np.repeat(before[np.minimum(first, max(len(h) - 1, 0))], sizes) if len(h) else 0
                total = np.bincount(owner, weight, len(sizes))[owner]
                # a shingle is in the prefix as long as it and what follows weigh enough
                tail = total - before
                use = tail >= (least - 1e-6) * total
                keep, tail = order[use], tail[use]
                part = batch.iloc[a:b]
                of = owner[keep]
                yield pd.DataFrame({
                    "h": h[keep].view(np.int64), "tail": tail, "rep": part["rep"].to_numpy()[of], "label": part["label"].to_numpy()[of],
                    "weight": part["weight"].to_numpy()[of], "rest": part["rest"].to_numpy()[of]})

    return run


def connected(edges: DataFrame, ws: Workspace) -> DataFrame:
    """``id, label``: the smallest id of each connected component of ``edges`` (a, b), for ids with an edge.

    Every round takes the smallest label around and then the label's own label,
    so rounds follow the logarithm of a component's width.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = ws.save(both, "edges")
    labels = ws.save(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        new = labels.join(near, "id").select("id", F.least("label", "near").alias("new"), "label")
        up = labels.select(F.col("id").alias("new"), F.col("label").alias("up"))
        new = ws.save(new.join(up, "new", "left").select("id", F.least("new", F.coalesce("up", "new")).alias("label"), F.col("label").alias("old")), "labels")
        ws.drop(labels)
        labels = new
        if labels.filter("label != old").isEmpty():
            ws.drop(both)
            return labels.select("id", "label")


def near_duplicates(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``doc_id, class_id, rep_id, class_size`` for every row of ``docs`` (doc_id, text).

    ``rep_id`` is the smallest doc_id with the same text, ``class_id`` the
    smallest of the class: texts joined by links of similarity ``least`` or more,
    found by the bands.  Equal texts share a class, empty and null ones too.  A
    null doc_id is smaller than any other, so its class has a null class_id.
    Rows that repeat a doc_id count each.  Texts of any length are taken whole;
    an empty table gives an empty result.
    """
    named = _classes(docs, least)
    classes = named.groupBy("label").agg(F.min("k").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    shown = lambda c: F.when(F.col(c) != F.lit(NULL_KEY), F.col(c)).alias(c)
    return named.join(classes, "label").select(shown("k").alias("doc_id"), shown("class_id"), shown("rep_id"), "class_size")


def _classes(docs: DataFrame, least: float) -> DataFrame:
    """``k, text_hash, rep_id, label`` for every row of ``docs``: rows of a class have the same label."""
    rows = docs.select(key_of().alias("k"), text_bytes().alias("b"))
    spark = docs.sparkSession
    ws = Workspace(spark, "near")
    shared = spark.sparkContext.broadcast(frequencies(rows.select("b")))

    hashed = rows.select("k", "b", F.sha2("b", 256).alias("text_hash"))
    signs = ws.save(hashed.mapInPandas(lean(_signatures(shared)), "k long, text_hash string, bands array<long>, weight double"), "signatures")
    # equal texts become one representative before anything is paired
    reps = signs.groupBy("text_hash").agg(F.min("k").alias("k"), F.min(F.struct("bands", "weight")).alias("s"))
    # numbered when written, so a number stays with its text whatever runs again
    reps = ws.save(reps.select("text_hash", "k", "s.*").withColumn("rep", F.monotonically_increasing_id()), "representatives")
    banded = reps.select("rep", "weight", F.posexplode("bands").alias("band", "key"))
    several = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = ws.save(several, "buckets")
    members = ws.save(matching(banded, several, ["band", "key"]).select("band", "key", "rep", "weight"), "members")
    # the hub is the member that meets most others over all bands: what copies were made from meets more than a copy
    meets = ws.save(members.join(several, ["band", "key"]).groupBy("rep").agg(F.sum("n").alias("meets")), "meets")
    several = members.join(meets, "rep").groupBy("band", "key").agg(F.max(F.struct("meets", F.col("rep").alias("rep"), "weight")).alias("hub"))
    several = ws.save(several, "hubs")
    # representatives' texts that any bucket holds, once
    held = ws.save(reps.join(members.select("rep").distinct(), "rep", "left_semi").select("k", "text_hash", "rep"), "held")
    maybe = mark_possible(hashed, held, ["k", "text_hash"], "maybe").filter("maybe").drop("maybe")
    texts = ws.save(maybe.join(held, ["k", "text_hash"]).dropDuplicates(["rep"]).select("rep", "b"), "texts")
    # the smaller weight over the larger bounds the similarity
    near_weight = lambda a, b: F.least(a, b) >= F.greatest(a, b) * F.lit(least - 1e-9)

    def verify(pairs: DataFrame) -> DataFrame:
        """Links among ``pairs`` (a, b)."""
        left = texts.select(F.col("rep").alias("a"), F.col("b").alias("x"))
        right = texts.select(F.col("rep").alias("b"), F.col("b").alias("y"))
        # joined by a last, so a hub's shingles are made once for a run of its members
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
        return both.mapInPandas(lean(_similar(shared, least)), "a long, b long, similarity double")

    star = members.join(several, ["band", "key"]).filter((F.col("rep") != F.col("hub.rep")) & near_weight(F.col("weight"), F.col("hub.weight")))
    links = ws.save(verify(star.select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()), "links")
    labels = connected(links, ws)
    now = ws.save(members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")), "labelled")
    ws.drop(meets, several)
    # buckets whose members are in several classes, with the largest one
    sizes = now.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("n"))
    open_ = sizes.groupBy("band", "key").agg(F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("classes"))
    open_ = ws.save(open_.filter("classes > 1").select("band", "key", F.col("most.label").alias("main")), "open")
    # every text of an open bucket once, and whether it is outside the largest class of one
    inside = now.join(open_, ["band", "key"]).groupBy("rep").agg(F.min("label").alias("label"), F.min("weight").alias("weight"), F.max(F.col("label") != F.col("main")).alias("rest"))
    inside = ws.save(inside, "inside")
    firsts = ws.save(texts.join(inside, "rep").select("rep", "label", "weight", "rest", "b").mapInPandas(
        lean(_prefixes(shared, least)), "h long, tail double, rep long, label long, weight double, rest boolean"), "prefixes")
    one = firsts.filter("rest").select("h", F.col("rep").alias("a"), F.col("label").alias("la"), F.col("weight").alias("wa"), F.col("tail").alias("ta"))
    two = matching(firsts, ws.save(one.select("h").distinct(), "prefix-shingles"), ["h"]).select("h", F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("weight").alias("wb"), F.col("tail").alias("tb"))
    # what a pair shares follows its first common shingle: both tails there weigh at least what the similarity asks for
    enough = F.least("ta", "tb") >= (F.col("wa") + F.col("wb")) * F.lit(least / (1 + least) - 1e-6)
    pairs = one.join(two, "h").filter((F.col("la") != F.col("lb")) & near_weight(F.col("wa"), F.col("wb")) & enough)
    more = verify(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = connected(ws.save(links.unionByName(more), "links"), ws)
    ws.drop(texts, firsts, members, now)
    named = signs.select("k", "text_hash").join(reps.select("text_hash", "rep", F.col("k").alias("rep_id")), "text_hash")
    return named.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("k", "text_hash", "rep_id", F.coalesce("label", "rep").alias("label"))


def drop_near_copies(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The columns of ``docs`` for one row of each class: that of the smallest doc_id, then of the smallest hash of the text.

    Null doc_ids are the smallest; rows that repeat doc_id and text count as one.
    """
    best = _classes(docs, least).groupBy("label").agg(F.min(F.struct("k", "text_hash")).alias("best"))
    best = best.select(F.col("best.k").alias("_qw_k"), F.col("best.text_hash").alias("_qw_h"))
    rows = docs.withColumns({"_qw_k": key_of(), "_qw_h": F.sha2(text_bytes(), 256)})
    return rows.join(best, ["_qw_k", "_qw_h"], "left_semi").dropDuplicates(["_qw_k", "_qw_h"]).select(docs.columns)
