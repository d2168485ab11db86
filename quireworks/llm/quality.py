"""Quality rules: a base rule and gradient-boosted trees over document statistics.

Statistics are taken of every whole text in one pass.  Trees are grown on a
bounded sample of labelled documents and flattened into numpy node arrays, one
row per tree, so a batch is scored by a few vectorised look-ups per level.
Chosen statistics may only raise the estimate of poor quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, text_bytes

#: Labelled documents that the trees are fitted on, at most.
SAMPLE = 6000
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share",
    "distinct_share", "log_words", "words_per_line", "top_word_share", "symbol_word_share", "bang_share"]
#: Statistics of which more never makes a document better.
RISING = ("symbol_share", "dup_line_share", "repeat_share", "symbol_word_share", "bang_share", "top_word_share")
#: Labelled documents from which a node is split; with fewer in all there are no trees.
SPLIT = 20
#: The estimate of poor quality from which a document goes.
REJECT = 0.5
_UPPER, _DIGIT, _PUNCT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"()-"


def statistics(text: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """(COUNTS, FEATURES) of the UTF-8 bytes of a text.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D.
    """
    words = text.split()
    n = len(words)
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    kept = lambda chars: len(text) - len(text.translate(None, chars))
    symbols = kept(SYMBOLS)
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = 0
    if n >= 3 and len(number) < n:
        a = np.asarray(ids, np.int64)
        size = np.int64(len(number) + 1)
        pair = np.unique(a[:-1] * size + a[1:], return_inverse=True)[1]
        window, count = np.unique(pair[:-1] * size + a[2:], return_inverse=True, return_counts=True)[1:]
        again = count[window] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeat = int(covered.sum())
    top = int(np.bincount(ids).max()) if n else 0
    d, size = max(n, 1), max(len(joined), 1)
    marked = sum(1 for w in number if w.translate(None, SYMBOLS) != w) if symbols else 0
    features = (
        chars / d, symbols / size, dup / max(lines, 1), repeat / d, kept(_UPPER) / size, kept(_DIGIT) / size, kept(_PUNCT) / size,
        len(number) / d, float(np.log1p(n)), n / max(lines, 1), top / d, marked / max(len(number), 1), text.count(b"!") / d)
    return (n, chars, symbols, dup, repeat), features


@dataclass
class Trees:
    """Complete binary trees of one depth as arrays: node i has children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # goes right if the value is above
    leaf: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of poor quality for each row."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (leaf.shape[0] - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, rising: tuple[int, ...] = ()) -> Trees:
    """Boosted trees for the log odds of y = 1, by histograms of quantile bins.

    A split on a feature of ``rising`` needs its right side to be no lower, and
    bounds both sides by the middle, so the sum never falls along it.
    """
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    coded = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)], 1)
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    score = np.full(len(y), start)
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        chance = 1 / (1 + np.exp(-score))
        g, h = y - chance, chance * (1 - chance)
        rows: dict[int, np.ndarray] = {0: np.arange(len(y))}
        bound = {0: (-np.inf, np.inf)}
        for node in range(inner):
            at, (low, high) = rows.pop(node), bound.pop(node)
            best, gain = None, 1e-6
            gs, hs = g[at].sum(), h[at].sum()
            value = lambda a, b: np.clip(a / (b + ridge), low, high)  # noqa: B023, E731
            worth = lambda a, b, v: a * v - 0.5 * (b + ridge) * v * v
            whole = worth(gs, hs, value(gs, hs))
            for f in range(x.shape[1]):
                m = len(edges[f])
                if not m or len(at) < SPLIT:
                    continue
                gl = np.cumsum(np.bincount(coded[at, f], g[at], m + 1))[:m]
                hl = np.cumsum(np.bincount(coded[at, f], h[at], m + 1))[:m]
                vl, vr = value(gl, hl), value(gs - gl, hs - hl)
                won = worth(gl, hl, vl) + worth(gs - gl, hs - hl, vr) - whole
                if f in rising:
                    won = np.where(vr >= vl, won, -np.inf)
                i = int(np.argmax(won))
                if won[i] > gain:
                    best, gain = (f, i, float(vl[i]), float(vr[i])), won[i]
            left, right = 2 * node + 1, 2 * node + 2
            sides = [(low, high), (low, high)]
            if best:
                f, i, vl, vr = best
                feature[t, node], cut[t, node] = f, edges[f][i]
                goes = coded[at, f] > i
                if f in rising:
                    sides = [(low, (vl + vr) / 2), ((vl + vr) / 2, high)]
            else:
                goes = np.zeros(len(at), bool)
            rows[left], rows[right], bound[left], bound[right] = at[~goes], at[goes], *sides
        for node, at in rows.items():
            low, high = bound[node]
            v = rate * float(np.clip(g[at].sum() / (h[at].sum() + ridge), low, high))
            leaf[t, node - inner] = v
            score[at] += v
    return Trees(feature, cut, leaf, start)


def _labelled(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") < 1).alias("bad"))


def prior_shift(labels: DataFrame, limit: int = SAMPLE) -> float:
    """What to add to log odds of a model fitted on ``sample_labels`` so that they hold for all labels."""
    sizes = {r["bad"]: r["n"] for r in _labelled(labels).groupBy("bad").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {bad: min(1.0, (limit // 2) / max(sizes.get(bad, 0), 1)) for bad in (True, False)}
    return float(np.log(share[False] / share[True]))


def sample_labels(labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """``doc_id, bad`` of at most ``limit`` labelled documents, half of each class, chosen by hash.

    Rows without an identifier or a quality are left out; a document labelled
    both ways counts as good.
    """
    each = _labelled(labels).withColumn("_h", F.xxhash64("doc_id"))
    half = [each.filter(F.col("bad") == bad).orderBy("_h", "doc_id").limit(limit // 2) for bad in (True, False)]
    return half[0].unionByName(half[1]).select("doc_id", "bad")


def fit_model(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Trees | None:
    """Trees fitted on labelled documents; None where a class has no document or no node could be split.

    The sample holds half of each class, so the log odds are shifted to the
    classes' shares among all labels: an estimate means the same at every size.
    """
    # at most `limit` pairs of a number and a flag
    picked = F.broadcast(sample_labels(labels, limit))
    rows = docs.select("doc_id", text_bytes().alias("b")).join(picked, "doc_id").dropDuplicates(["doc_id"])
    found = _measured(rows, ["doc_id", "bad"], {"doc_id": "long", "bad": "boolean"}).toPandas().sort_values("doc_id")
    y = found["bad"].to_numpy(float)
    if len(found) < SPLIT or y.min() == y.max():
        return None
    model = fit_trees(np.stack(found["features"].to_numpy()), y, rising=tuple(FEATURES.index(f) for f in RISING))
    model.start += prior_shift(labels, limit)
    return model


def _measured(rows: DataFrame, keep: list[str], types: dict[str, str]) -> DataFrame:
    schema = ", ".join([*(f"{c} {types[c]}" for c in keep), *(f"{c} long" for c in COUNTS), "features array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [statistics(b) for b in batch["b"]]
            out = pd.DataFrame([f[0] for f in found], columns=COUNTS)
            yield pd.concat([batch[keep].reset_index(drop=True), out, pd.Series([f[1] for f in found], name="features", dtype=object)], axis=1)[[*keep, *COUNTS, "features"]]

    return rows.mapInPandas(lean(run), schema)


VERDICT = ", ".join([*(f"{c} long" for c in COUNTS), "poor double"])


def judge(docs: DataFrame, model: Trees | None, into: str = "verdict") -> DataFrame:
    """``docs`` with the struct ``into`` (COUNTS, poor, base_failed, kept); rows and columns stay, but for a column of that name.

    A document fails the base rule with under 50 words, or if more than half of
    its words lie in 3-word windows found twice or more.  Else it goes if the
    model's estimate of poor quality reaches REJECT.  A null text has no words.
    """
    @F.pandas_udf(VERDICT)
    def measure(column: pd.Series) -> pd.DataFrame:
        found = [statistics(b) for b in column]
        out = pd.DataFrame([f[0] for f in found], columns=COUNTS)
        if model is None or not len(found):
            return out.assign(poor=0.0)
        return out.assign(poor=1 / (1 + np.exp(-model.score(np.array([f[1] for f in found])))))

    out = docs.withColumn(into, measure(text_bytes()))
    failed: Column = (F.col(f"{into}.n_words") < 50) | (100 * F.col(f"{into}.n_repeat_words") > 50 * F.col(f"{into}.n_words"))
    out = out.withColumn(into, F.col(into).withField("base_failed", failed))
    return out.withColumn(into, F.col(into).withField("kept", ~F.col(f"{into}.base_failed") & (F.col(f"{into}.poor") < REJECT)))
