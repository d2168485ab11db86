"""Language-model scoring with Brown class-based n-grams.

P(word | previous) = P(class(word) | class(previous)) * P(word | class(word)).

Counts come from all training texts.  Exchange clustering runs over the whole
vocabulary of the training texts: sweep by sweep every word moves to the class
that raises the likelihood of the class bigrams most.  The CORE most frequent
words start it one by one on the driver, on their own bigram counts.  In each
sweep the counts of a word with the classes before and after it are gathered
over all texts: as matrices for the FREQUENT words, which the driver moves with
the exact change of likelihood, their own counts taken out; as rows for all
others, which a distributed pass moves with the change's first-order term.
From the second sweep on, words beyond the dictionary count as neighbours with
the classes that the sweep before gave them.  A sweep that lowers the likelihood is undone.

Words are known to tasks by 64-bit hashes in sorted arrays: the DICTIONARY most
frequent ones with their counts and classes.  Counts and classes of the other
words come back by a join.  Only words that no training text holds share a class
of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, Workspace, key_of, text_bytes
from .wordhash import WordHasher, steps

#: Words of the sequential start, words the driver moves, words that tasks know the counts and classes of, sweeps over all words.
CORE, FREQUENT, DICTIONARY, SWEEPS = 1024, 8192, 1 << 20, 2
CLASSES = 48
ADD = 0.1  # added to every count of a word
SMOOTH = 0.5  # added to every count of a class bigram
#: Rows of matrices that one task sums; distinct words that a task gathers before it sends them on.
ROWS, FLUSH = 64, 400_000

_SPACES = bytes(32 if c in b" \t\n\v\f\r" else c for c in range(256))


class Words:
    """Hashes of the words of texts: runs of bytes other than 0x20 and 0x09 to 0x0D, A-Z lower-cased."""

    def __init__(self) -> None:
        self.hasher = WordHasher()

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, number of words of each text)."""
        return self.hasher([t.lower().translate(_SPACES) for t in texts])


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words, held, size = Words(), [], 0

    def flush() -> pd.DataFrame:
        h = np.concatenate([x for x, _ in held])
        n = np.concatenate([x for _, x in held])
        of, at = np.unique(h, return_inverse=True)
        held[:] = [(of, np.bincount(at, n, len(of)).astype(np.int64))]
        return pd.DataFrame({"word": held[0][0].view(np.int64), "n": held[0][1]})

    for batch in batches:
        texts = batch["b"].tolist()
        for a, b in steps(texts):
            held.append(np.unique(words(texts[a:b])[0], return_counts=True))
            size += len(held[-1][0])
            if size > 2 * FLUSH:
                out = flush()
                size = len(out)
                if size > FLUSH:
                    yield out
                    held.clear()
                    size = 0
    if held:
        yield flush()


def count_words(train: DataFrame) -> DataFrame:
    """``word, n`` of the training texts (b); words by their hash."""
    return train.select("b").mapInPandas(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(vocabulary: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) by falling count, ``most`` words at most: those above a count that a histogram of counts gives.

    The histogram has 64 steps for each doubling, so the driver gets a few
    thousand numbers and then the words' hashes, whatever the vocabulary.
    """
    step = F.floor(F.log2("n") * 64).cast("long")
    sizes = {r["step"]: r["words"] for r in vocabulary.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()}
    taken, cut = 0, None
    for key in sorted(sizes, reverse=True):
        if taken + sizes[key] > most:
            break
        taken, cut = taken + sizes[key], key
    if cut is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed = vocabulary.filter(step >= cut).mapInPandas(_packed, "h binary, n binary").collect()  # few rows, many words each
    h = np.concatenate([np.frombuffer(r["h"], np.uint64) for r in packed])
    n = np.concatenate([np.frombuffer(r["n"], np.int64) for r in packed])
    order = np.lexsort((h, -n))
    return h[order], n[order]


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            yield pd.DataFrame({"h": [batch["word"].to_numpy(np.int64).tobytes()], "n": [batch["n"].to_numpy(np.int64).tobytes()]})


class Exchange:
    """Exchange clustering of words by their bigram counts (Kneser and Ney; Martin, Liermann and Ney)."""

    def __init__(self, pairs: np.ndarray, classes: int):
        self.pairs = pairs.astype(float)
        self.n = len(pairs)
        self.of = np.arange(self.n) % classes  # by rank: frequent words start apart
        self.classes = classes
        one = np.eye(classes)[self.of]
        self.table = one.T @ self.pairs @ one

    @staticmethod
    def xlogx(a: np.ndarray) -> np.ndarray:
        return a * np.log(np.maximum(a, 1e-300))

    @classmethod
    def likelihood(cls, table: np.ndarray) -> float:
        return float(cls.xlogx(table).sum() - cls.xlogx(table.sum(0)).sum() - cls.xlogx(table.sum(1)).sum())

    @classmethod
    def gains(cls, t: np.ndarray, right: np.ndarray, left: np.ndarray, both: float, most: int) -> np.ndarray:
        """Change of likelihood if a word joins each of the first ``most`` classes of ``t``, which is without the word.

        ``right`` and ``left``: its counts with the class after and before it; ``both``: with itself.
        """
        base = cls.xlogx(t)
        rows, cols = cls.xlogx(t + right[None, :]), cls.xlogx(t + left[:, None])
        gain = (rows - base).sum(1) + (cols - base).sum(0)
        d = np.diagonal(t)
        gain += cls.xlogx(d + right + left + both) - np.diagonal(rows) - np.diagonal(cols) + cls.xlogx(d)
        for total, more in ((t.sum(1) + left, right.sum() + both), (t.sum(0) + right, left.sum() + both)):
            gain -= cls.xlogx(total + more) - cls.xlogx(total)
        return gain[:most]

    def move(self, w: int) -> bool:
        """Moves word w to its best class; whether it moved."""
        c, of = self.of[w], self.of
        right = np.bincount(of, self.pairs[w], self.classes)
        left = np.bincount(of, self.pairs[:, w], self.classes)
        both = self.pairs[w, w]
        right[c] -= both
        left[c] -= both
        t = without(self.table, c, right, left, both)
        gain = self.gains(t, right, left, both, self.classes)
        new = int(np.argmax(gain))
        if gain[new] <= gain[c] + 1e-9:
            return False
        t[new, :] += right
        t[:, new] += left
        t[new, new] += both
        self.table, self.of[w] = t, new
        return True

    def run(self, sweeps: int = 8) -> np.ndarray:
        for _ in range(sweeps):
            if not sum(self.move(w) for w in range(self.n)):
                break
        return self.of


def without(table: np.ndarray, c: int, right: np.ndarray, left: np.ndarray, both: float) -> np.ndarray:
    """A class table without the counts of a word of class ``c``."""
    t = table.copy()
    t[c, :] -= right
    t[:, c] -= left
    t[c, c] -= both
    return np.maximum(t, 0)


def _sum_matrix(parts: DataFrame, rows: int, columns: int) -> np.ndarray:
    """A rows x columns matrix from ``block, cells`` (compressed blocks of ROWS rows); its size does not follow the input."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch["block"].tolist(), batch["cells"], strict=True):
                part = np.frombuffer(zlib.decompress(cells), "<i8")
                total[block] = total[block] + part if block in total else part
        yield pd.DataFrame([(i, zlib.compress(part.tobytes(), 1)) for i, part in total.items()], columns=["block", "cells"]).astype({"block": "int32"})

    out = np.zeros((_pad(rows), columns), np.int64)
    for row in parts.repartition(16, "block").mapInPandas(add, "block int, cells binary").collect():
        out[row["block"] * ROWS : (row["block"] + 1) * ROWS] += np.frombuffer(zlib.decompress(row["cells"]), "<i8").reshape(ROWS, columns)
    return out[:rows]


def _pad(rows: int) -> int:
    return -(-rows // ROWS) * ROWS


def _blocks(matrix: np.ndarray) -> pd.DataFrame:
    out = np.zeros((_pad(len(matrix)), matrix.shape[1]), matrix.dtype)
    out[: len(matrix)] = matrix
    found = [(i, zlib.compress(np.ascontiguousarray(part, "<i8").tobytes(), 1)) for i in range(len(out) // ROWS) if (part := out[i * ROWS : (i + 1) * ROWS]).any()]
    return pd.DataFrame(found, columns=["block", "cells"]).astype({"block": "int32"})


CODED = "k long, h long, held_out boolean, n_words long, known long, mass double, codes binary, rare array<long>"


def _code(shared):
    """Codes texts: 32-bit ranks in the dictionary; other words have the code ``rare`` and are listed by hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, ranks, logs = shared.value
        words, other = Words(), len(hashes) + 1
        for batch in batches:
            texts = batch["b"].tolist()
            for a, b in steps(texts):
                h, n = words(texts[a:b])
                of, back = np.unique(h, return_inverse=True)
                at = np.minimum(np.searchsorted(hashes, of), max(len(hashes) - 1, 0))
                hit = hashes[at] == of if len(hashes) else np.zeros(len(of), bool)
                code = np.where(hit, ranks[at] if len(hashes) else 0, other).astype("<u4")[back]
                log = np.where(hit, logs[at] if len(hashes) else 0.0, 0.0)[back]
                known = hit[back]
                ends = np.cumsum(n)
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])  # noqa: B023, E731
                mass = np.bincount(np.repeat(np.arange(len(n)), n), log, len(n))
                rare, missed = h.view(np.int64), np.flatnonzero(~known)
                cut = np.searchsorted(missed, np.concatenate([[0], ends])).tolist()
                part = batch.iloc[a:b]
                yield pd.DataFrame({
                    "k": part["k"].to_numpy(), "h": part["h"].to_numpy(), "held_out": part["held_out"].to_numpy(), "n_words": n, "known": total(known), "mass": mass,
                    "codes": [code[e - m : e].tobytes() for e, m in zip(ends.tolist(), n.tolist(), strict=True)],
                    "rare": [rare[missed[x:y]].tolist() for x, y in zip(cut[:-1], cut[1:], strict=True)]})

    return run


def _core_pairs(core: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(core * core, np.int64)
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for codes in batch["codes"]:
                a = np.frombuffer(codes, np.uint32).astype(np.int64)
                if len(a) > 1:
                    both = (a[:-1] < core) & (a[1:] < core)
                    found.append(a[:-1][both] * core + a[1:][both])
            total += np.bincount(np.concatenate(found), minlength=core * core)
        yield _blocks(total.reshape(core, core))

    return run


def _joined(batch: pd.DataFrame, edge: int) -> np.ndarray:
    """All codes of a batch, each text between two edges."""
    mark = np.asarray([edge], np.uint32).tobytes()
    return np.frombuffer(mark + b"".join(c + mark for c in batch["codes"]), np.uint32)


def _classes_of(batch: pd.DataFrame, codes: np.ndarray, classes: np.ndarray, edge: int) -> np.ndarray:
    """Classes of a batch's ``codes``: those of words beyond the dictionary are ``filled`` in where they are known."""
    c, filled = classes[codes], [f for f in batch["filled"] if f is not None]
    if filled:
        c[codes == edge + 1] = np.concatenate(filled)
    return c


def _contexts(shared, words: int, n: int, edge: int):
    """Counts of (word, class before), (word, class after) and (word, itself after it) for words below ``words``, then those of class bigrams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes, wide = shared.value.astype(np.int32), 2 * n + 1
        total, table = np.zeros(words * wide, np.int64), np.zeros(n * n, np.int64)
        for batch in batches:
            codes = _joined(batch, edge)
            c = _classes_of(batch, codes, classes, edge)
            table += np.bincount(c[:-1] * n + c[1:], minlength=n * n)
            for at, near, side in ((codes[1:], c[:-1], 0), (codes[:-1], c[1:], n)):
                use = np.flatnonzero(at < words)
                total += np.bincount(at[use].astype(np.int64) * wide + side + near[use], minlength=len(total))
            same = codes[:-1][(codes[:-1] == codes[1:]) & (codes[:-1] < words)]
            total[2 * n :: wide] += np.bincount(same, minlength=words)
        last = np.zeros((-(-n * n // wide), wide), np.int64)
        last.reshape(-1)[: n * n] = table
        yield _blocks(np.concatenate([total.reshape(words, wide), last]))

    return run


def _surroundings(shared, least: int, edge: int):
    """Words of rank ``least`` or more with the classes before and after each occurrence, a byte each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes, other = shared.value, edge + 1
        for batch in batches:
            codes = _joined(batch, edge)
            c = _classes_of(batch, codes, classes, edge)
            at = np.flatnonzero((codes >= least) & (codes != edge))
            at = at[np.argsort(codes[at], kind="stable")]
            near, own = np.stack([c[at - 1], c[at + 1]], 1), codes[at]
            inside = int(np.searchsorted(own, other))
            ends = np.append(np.flatnonzero(np.diff(own[:inside])) + 1, inside) if inside else np.zeros(0, np.int64)
            starts, held = np.append(0, ends[:-1])[: len(ends)], near.tobytes()
            yield pd.DataFrame({
                "word": own[starts].astype(np.int64), "rare": False, "near": [held[2 * a : 2 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]})
            beyond = np.array([w for rare in batch["rare"] for w in rare], np.int64)
            order = np.argsort(beyond, kind="stable")
            first = np.flatnonzero(np.diff(beyond[order], prepend=beyond[order][:1] - 1)) if len(beyond) else np.zeros(0, np.int64)
            held = near[inside:][order].tobytes()
            yield pd.DataFrame({
                "word": beyond[order][first], "rare": True, "near": [held[2 * a : 2 * b] for a, b in zip(first.tolist(), np.append(first[1:], len(beyond)).tolist()[: len(first)], strict=True)]})

    return run


def _assign(logs: np.ndarray):
    """The class that the neighbours' classes make likeliest: the first-order change of likelihood."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = len(logs)
        for batch in batches:
            joined = [b"".join(near) for near in batch["near"]]
            pairs = np.frombuffer(b"".join(joined), np.uint8).astype(np.int64).reshape(-1, 2)
            own = np.repeat(np.arange(len(joined)), [len(x) // 2 for x in joined]) * wide
            count = np.bincount(own + pairs[:, 0], minlength=len(joined) * wide) + np.bincount(own + pairs[:, 1] + wide // 2, minlength=len(joined) * wide)
            yield batch[["word", "rare"]].assign(cls=np.argmax(count.reshape(-1, wide) @ logs, 1).astype(np.int32))

    return run


CLASSED = "k long, h long, held_out boolean, n_words long, known long, mass double, path binary"


def _classed(shared, edge: int):
    """The classes of each text's words between two edges, a byte each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = shared.value
        mark = np.asarray([edge], np.uint32).tobytes()
        for batch in batches:
            path = []
            for codes, filled in zip(batch["codes"], batch["filled"], strict=True):
                codes = np.frombuffer(mark + codes + mark, np.uint32)
                c = classes[codes]
                if filled is not None:
                    c[codes == edge + 1] = filled
                path.append(c.tobytes())
            yield batch[["k", "h", "held_out", "n_words", "known", "mass"]].assign(path=path)

    return run


def _class_pairs(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            c = np.frombuffer(b"".join(batch["path"]), np.uint8).astype(np.int64)
            # one text's end and the next one's start are no pair
            use = np.ones(len(c), bool)
            use[np.cumsum([len(p) for p in batch["path"]], dtype=np.int64) - 1] = False
            at = np.flatnonzero(use)
            total += np.bincount(c[at] * n + c[at + 1], minlength=n * n)
        yield _blocks(total.reshape(n, n))

    return run


def _score(step: np.ndarray):
    """Sum of log10 P(class | class before) - log10 of the class's smoothed mass, over a text and its end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            path = [np.frombuffer(p, np.uint8) for p in batch["path"]]
            yield batch.assign(path=[float(step[p[:-1], p[1:]].sum()) for p in path])

    return run


def score_texts(docs: DataFrame, core: int = CORE, frequent: int = FREQUENT, dictionary: int = DICTIONARY, n_classes: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs`` (doc_id, text).

    Training texts are those with crc32(doc_id as text) mod 10 other than 0; a
    null doc_id counts as training.  A null text is empty: its one token is the
    end.  base_score is the smoothed unigram log10 probability, score the class
    model's.  Rows that repeat doc_id and text are scored alike.  An empty table
    gives an empty result.
    """
    return ClassModel(docs, core, frequent, dictionary, n_classes, sweeps).score()


class ClassModel:
    """The class model of the training texts of ``docs``: classes of the dictionary's words in ``classes``, of the others in ``word_classes``."""

    def __init__(self, docs: DataFrame, core: int = CORE, frequent: int = FREQUENT, dictionary: int = DICTIONARY, n_classes: int = CLASSES, sweeps: int = SWEEPS):
        spark = docs.sparkSession
        share = spark.sparkContext.broadcast
        self.ws = ws = Workspace(spark, "brown")
        held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
        rows = docs.select(key_of().alias("k"), F.xxhash64(text_bytes()).alias("h"), held.alias("held_out"), text_bytes().alias("b"))
        self.vocabulary = ws.save(count_words(rows.filter("not held_out")), "words")
        total = self.vocabulary.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.ends = rows.filter("not held_out").count()
        self.n_tokens, self.v = (total["n"] or 0) + self.ends, total["v"] + (self.ends > 0)
        hashes, self.counts = frequent_words(self.vocabulary, dictionary)
        # classes: those of the words, one for words without a class yet, one for the edge of a text
        self.n_classes, self.n = n_classes, n_classes + 2
        self.edge = edge = len(hashes)
        order = np.argsort(hashes)
        self.hashes, self.ranks = hashes[order], order.astype(np.uint32)
        known = share((self.hashes, self.ranks, np.log10(self.counts[order] + ADD)))
        self.coded = ws.save(rows.mapInPandas(_code(known), CODED), "coded")
        known.unpersist()
        self.train = self.coded.filter("not held_out").select("k", "h", "codes", "rare")
        # whether any training word lies beyond the dictionary
        self.more_words = edge < total["v"]
        frequent = min(frequent, edge)
        core = min(core, frequent)
        classes = np.full(edge + 2, n_classes, np.uint8)
        classes[edge] = n_classes + 1
        if core:
            pairs = _sum_matrix(self.train.mapInPandas(_core_pairs(core), "block int, cells binary"), core, core)
            classes[:core] = Exchange(pairs, n_classes).run()
        self.classes, self.beyond = classes, None
        before, kept = -np.inf, (classes, None)
        for sweep in range(sweeps if total["v"] else 0):
            likelihood, moved, beyond = self._sweep(frequent)
            # the first sweep gives classes to words that have none: likelihoods compare from the second on
            if sweep > 1 and likelihood < before:
                self.classes, self.beyond = kept
                break
            before, kept = likelihood, (self.classes, self.beyond)
            self.classes, self.beyond = moved, beyond

    def _sweep(self, frequent: int) -> tuple[float, np.ndarray, DataFrame | None]:
        """(likelihood of the classes as they are, classes of the dictionary after a sweep, ``word, cls`` of the words beyond it)."""
        share, n, k = self.train.sparkSession.sparkContext.broadcast, self.n, self.n_classes
        shared = share(self.classes)
        if self.beyond is not None and self.more_words:
            # words beyond the dictionary count with the classes that the sweep before gave them
            filled = self._rare(self.train, self.beyond.filter("rare").select("word", F.lit(1).alias("n"), "cls")).select("k", "h", "filled")
            train = self.ws.save(self.train.join(filled, ["k", "h"], "left"), "train")
        else:
            train = self.train.withColumn("filled", F.lit(None).cast("array<int>"))
        wide = 2 * n + 1
        extra = -(-n * n // wide)
        found = _sum_matrix(train.mapInPandas(_contexts(shared, frequent, n, self.edge), "block int, cells binary"), frequent + extra, wide).astype(float)
        table, near = found[frequent:].reshape(-1)[: n * n].reshape(n, n), found[:frequent]
        moved = self.classes.copy()
        for w in range(frequent):
            left, right, both, c = near[w, :n].copy(), near[w, n : 2 * n].copy(), near[w, 2 * n], self.classes[w]
            if not left.any() and not right.any():
                continue
            left[c] -= both
            right[c] -= both
            moved[w] = np.argmax(Exchange.gains(without(table, c, right, left, both), right, left, both, k))
        # first-order change of likelihood by a neighbour before or after the word
        t = table[:, :k] + SMOOTH
        u = table[:k, :] + SMOOTH
        logs = np.concatenate([np.log(t / t.sum(0)), np.log(u / u.sum(1, keepdims=True)).T])
        words = train.mapInPandas(_surroundings(shared, frequent, self.edge), "word long, rare boolean, near binary")
        words = words.groupBy("word", "rare").agg(F.collect_list("near").alias("near")).mapInPandas(_assign(logs), "word long, rare boolean, cls int")
        words = self.ws.save(words, "word-classes")
        if hasattr(train, "saved_path"):
            self.ws.drop(train)
        packed = words.filter("not rare").select("word", F.col("cls").cast("long").alias("n")).mapInPandas(_packed, "h binary, n binary")
        for r in packed.collect():  # words of the dictionary: few rows, many words each
            moved[np.frombuffer(r["h"], np.int64)] = np.frombuffer(r["n"], np.int64)
        return Exchange.likelihood(table), moved, words

    def _rare(self, coded: DataFrame, beyond: DataFrame) -> DataFrame:
        """For each text (k, h) with words beyond the dictionary: their classes in the text's order, how many are known, their weight."""
        rare = coded.filter(F.size("rare") > 0).dropDuplicates(["k", "h"]).select("k", "h", F.posexplode("rare").alias("pos", "word"))
        cls = F.struct("pos", F.coalesce("cls", F.lit(self.n_classes)).alias("cls"))
        return rare.join(beyond, "word", "left").groupBy("k", "h").agg(
            F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))).alias("weight"),
            F.sort_array(F.collect_list(cls))["cls"].alias("filled"))

    def word_classes(self) -> DataFrame:
        """``word, n, cls`` of the words beyond the dictionary."""
        return self.beyond.filter("rare").join(self.vocabulary, "word").select("word", "n", "cls")

    def score(self) -> DataFrame:
        ws, n, n_classes = self.ws, self.n, self.n_classes
        share = self.train.sparkSession.sparkContext.broadcast
        coded = self.coded
        # words beyond the dictionary: their exact counts and their classes in the text's order
        if self.beyond is not None:
            beyond = ws.save(self.word_classes(), "beyond")
        else:
            beyond = self.vocabulary.filter("false").select("word", "n", F.lit(0).alias("cls"))
        rare = ws.save(self._rare(coded, beyond), "rare")
        whole = coded.drop("rare").join(rare.select("k", "h", "filled"), ["k", "h"], "left")
        classed = ws.save(whole.mapInPandas(_classed(share(self.classes), self.edge), CLASSED), "classed")
        steps_ = _sum_matrix(classed.filter("not held_out").select("path").mapInPandas(_class_pairs(n), "block int, cells binary"), n, n).astype(float)
        # a word's mass within its class: (c + ADD) / (tokens of the class + ADD * words of the class)
        own = self.classes[: self.edge]
        mass = np.bincount(own, self.counts, n) + ADD * np.bincount(own, minlength=n)
        for r in beyond.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
            mass[r["cls"]] += r["n"] + ADD * r["words"]
        mass[n_classes] += ADD  # one unseen word
        mass[n_classes + 1] = self.ends + ADD
        # a text's edge before its first token is one class with its end
        chance = (steps_ + SMOOTH) / (steps_ + SMOOTH).sum(1, keepdims=True)
        step = np.log10(chance) - np.log10(np.maximum(mass, ADD))[None, :]
        self.step = step
        ws.drop(coded)
        done = classed.mapInPandas(_score(step), "k long, h long, held_out boolean, n_words long, known long, mass double, path double")
        out = done.join(rare.drop("filled"), ["k", "h"], "left")
        length = F.col("n_words") + 1
        numerators = F.col("mass") + F.coalesce("weight", F.lit(0.0)) + F.lit(float(np.log10(self.ends + ADD)))
        base = numerators - length * F.lit(float(np.log10(self.n_tokens + ADD * (self.v + 1))))
        return out.select(
            F.when(F.col("k") != NULL_KEY, F.col("k")).alias("doc_id"), "held_out", length.alias("n_tokens"),
            (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(self.ends > 0))).alias("n_known"), F.lit(self.n_tokens).cast("long").alias("train_tokens"),
            base.alias("base_score"), (numerators + F.col("path")).alias("score"))
