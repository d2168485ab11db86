"""Best-fit packing by length patterns fitted with non-negative least squares.

Documents become token pieces of at most ``capacity`` tokens.  The histogram of
piece lengths is all the driver sees (``capacity`` numbers).  It enumerates
patterns of one to three lengths that fill a sequence, fits how often to use
each by non-negative least squares on the histogram, rounds down, and packs
what is left by best-fit decreasing on counts.  The plan names places by
(length, rank), and every piece finds its place by its rank among the pieces
of its length.
"""

from __future__ import annotations

import bisect
import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, bound_batches, key_of, lean

CAPACITY = 4096
#: Words that a task remembers the ids of, about, in each of two generations; and parts of words.
REMEMBERED = 250_000
#: Parts this long are not remembered; rows, and bytes of ids, that a task sends on at once.
LONG_PART, FLUSH, FLUSH_BYTES = 100, 2000, 4 << 20
#: Pieces of one length that one task ranks, about.
BUCKET_ROWS = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids binary"


#: Printable ASCII characters; words of these and of the letters of Latin-1 and Latin Extended-A, as UTF-8.  None of these
#: is a mark or composes with another, and each has one lower-case letter: U+00D7, U+00F7 and U+0130 are left out.
PRINTABLE = bytes(range(0x21, 0x7F))
LATIN = re.compile(rb"(?:[!-~]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])++").fullmatch

#: The pattern by which the vocabulary cuts such words in lower case (a fixed format); bytes from 0x80 are letters' there.
CUT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")

_ITSELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = [b for b in range(256) if b not in _ITSELF]
#: The character that stands for each byte in the vocabulary (a fixed format); the space parts words.
SHOWN = "".join(" " if b == 0x20 else chr(b if b in _ITSELF else 0x100 + _HIDDEN.index(b)) for b in range(256))


class WordTokenizer:
    """Ids of whole texts by the ``tokenizers`` library, as ``encode(text, add_special_tokens=False)`` gives them.

    Texts are cut at ASCII white space, which the vocabulary's normaliser drops
    and which no piece and no special string crosses.  The library encodes each
    distinct word while it is remembered, those of a batch of texts in one call.
    Words of printable ASCII characters and Latin letters without ``<|``, where
    no special string can begin, skip its normaliser: they are lower-cased, cut
    by CUT, and the library's merges run on each distinct part.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.library = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.library.model)
        self.merges.pre_tokenizer = CharDelimiterSplit(" ")
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a part
        self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        # words met since the last turn, and those of the generation before
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def new_parts(self, parts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Parts with their ids, by one call; a part's ids end with the first that ends one."""
        shown = codecs.charmap_decode(b" ".join(parts), "strict", SHOWN)[0]
        ids = np.asarray(self.merges.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
        ids = ids.tobytes()
        return ((p, ids[x:y]) for p, x, y in zip(parts, [0, *ends[:-1]], ends, strict=True))

    def plain_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        whole, cut = {}, {}
        for word, low in zip(words, b" ".join(words).decode().lower().encode().split(b" "), strict=True):
            if low.isalpha():
                whole[word] = low
            else:
                cut[word] = CUT.findall(low)
        # a part that is a word by itself has the same ids; it is remembered once
        parts, own, known, new = self.parts, set(words), {}, []
        for part in {*whole.values(), *chain.from_iterable(cut.values())}:
            if ids := parts.get(part) or self.words.get(part) or self.older.get(part):
                known[part] = ids
            else:
                new.append(part)
        if new:
            known.update(self.new_parts(new))
            parts.update((p, known[p]) for p in new if p not in own and len(p) < LONG_PART)
        out = {w: known[p] for w, p in whole.items()}
        for w, found in cut.items():
            out[w] = b"".join([known[p] for p in found])
        return out

    def other_words(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words with their ids, by one call; an id belongs to the word that its offset lies in."""
        texts = [w.decode("utf-8", "replace") for w in words]
        found = self.library.encode(" ".join(texts), add_special_tokens=False)
        ids = np.asarray(found.ids, "<u4").tobytes()
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cut = (4 * np.searchsorted(np.asarray([at for at, _ in found.offsets], np.int64), starts)).tolist()
        return ((w, ids[x:y]) for w, x, y in zip(words, cut[:-1], cut[1:], strict=True))

    def ids_of(self, found: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.words) > REMEMBERED:
            self.words, self.older = {}, self.words
        if len(self.parts) > REMEMBERED:
            self.parts = {}
        words, older, new, plain, other = self.words, self.older, {}, [], []
        out = list(map(words.get, found))
        missed = [i for i, ids in enumerate(out) if ids is None]
        for w in map(found.__getitem__, missed):
            if (ids := older.get(w)) is not None:
                new[w] = ids
            elif (not w.translate(None, PRINTABLE) or LATIN(w)) and b"<|" not in w:
                plain.append(w)
            else:
                other.append(w)
        if plain:
            new.update(self.plain_words(plain))
        if other:
            new.update(self.other_words(other))
        for i in missed:
            out[i] = new[found[i]]
        words.update(new)
        return out

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text; the distinct words of all texts are told apart outside Python and looked up once."""
        if not texts:
            return
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        found = cut.values.view(pa.large_binary()).dictionary_encode()
        ids = self.ids_of(found.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(ids, pa.large_binary()).take(found.indices)
        _, ends, whole = ids.buffers()
        ends = np.frombuffer(ends, np.int64, len(ids) + 1)[cut.offsets.to_numpy()].tolist()
        whole = memoryview(whole or b"")
        for x, y in zip(ends[:-1], ends[1:], strict=True):
            yield bytes(whole[x:y])

    def __call__(self, text: bytes) -> bytes:
        return next(self.encode([text]))


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit) of every whole text.

    A text's ids are followed by ``end_id``; only longer ones are cut, into
    pieces of ``capacity`` tokens.  A null text is empty: one piece with the end.
    """

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"]).astype({"doc_id": "Int64"})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = WordTokenizer(tokenizer_path).encode, np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            rows, held = [], 0
            for doc, ids in zip(batch["doc_id"], encode(batch["b"].tolist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, part))
                    held += len(part)
                    if len(rows) >= FLUSH or held >= FLUSH_BYTES:
                        yield frame(rows)
                        rows, held = [], 0
            yield frame(rows)

    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long"), text.alias("b")).mapInPandas(lean(cut), PIECES)


def patterns(lengths: np.ndarray, capacity: int, near: int = 2) -> list[tuple[int, ...]]:
    """Patterns of one to three present lengths that leave the least room."""
    have = sorted(int(x) for x in lengths)
    largest = lambda room: have[i - 1] if (i := bisect.bisect_right(have, room)) else None
    found = {(capacity,)} if have and have[-1] == capacity else set()
    for a in reversed(have):
        if a == capacity:
            continue
        i = bisect.bisect_right(have, capacity - a)
        for b in have[max(0, i - near) : i]:
            found.add((max(a, b), min(a, b)))
        for share in (0.5, 0.3, 0.15):  # a second length that takes this share of the room, and the best third
            b = largest(int((capacity - a) * share))
            c = largest(capacity - a - b) if b else None
            if c:
                found.add(tuple(sorted((a, b, c), reverse=True)))
    return [p for p in found if sum(p) >= capacity - 8]


def fit_counts(found: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = 20) -> np.ndarray:
    """Non-negative least squares of the patterns' repeat counts against the histogram, by coordinate descent."""
    counts, rest = np.zeros(len(found)), histogram.astype(float).copy()
    columns = [tuple(zip(*np.unique(p, return_counts=True), strict=True)) for p in found]
    for _ in range(sweeps):
        moved = 0.0
        for j, column in enumerate(columns):
            step = sum(m * rest[n] for n, m in column) / sum(m * m for _, m in column)
            step = max(step, -counts[j])
            counts[j] += step
            for n, m in column:
                rest[n] -= m * step
            moved += abs(step)
        if moved < 0.5:
            break
    return counts


@dataclass
class Plan:
    """Per length: ``ranks`` from which a run of places starts, its first sequence and the place's offset."""

    ranks: dict[int, np.ndarray]
    sequences: dict[int, np.ndarray]
    offsets: dict[int, np.ndarray]
    n_sequences: int


def make_plan(histogram: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """``histogram[n]``: pieces of n tokens.  Every piece gets a place."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    groups: list[tuple[tuple[int, ...], int]] = []
    found = sorted(patterns(np.flatnonzero(left), capacity), key=lambda p: (-sum(p), p))
    for pattern, want in zip(found, fit_counts(found, left), strict=True):
        need = dict(zip(*np.unique(pattern, return_counts=True), strict=True))
        n = min(int(want), *(int(left[k]) // int(m) for k, m in need.items()))
        if n > 0:
            groups.append((pattern, n))
            for k, m in need.items():
                left[k] -= n * m
    # the residual: best fit decreasing, on groups of equal bins
    rooms: list[int] = []
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = capacity - sum(pattern)
        if room == 0:
            groups.append((pattern, n))
            return
        if room not in by_room:
            bisect.insort(rooms, room)
            by_room[room] = []
        by_room[room].append((pattern, n))

    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                pattern, n = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[i]
                each = min(room // length, count)  # a bin that took one is the best fit for the next
                take = min(n, count // each)
                put(pattern + (length,) * each, take)
                if take < n:
                    put(pattern, n - take)
                count -= take * each
            else:
                each = capacity // length
                if count >= each:
                    put((length,) * each, count // each)
                if count % each:
                    put((length,) * (count % each), 1)
                count = 0
    for kept in by_room.values():
        groups.extend(kept)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, n in groups:
        offset = 0
        for length in pattern:
            runs.setdefault(length, []).append((n, sequence, offset))
            offset += length
        sequence += n
    plan = Plan({}, {}, {}, sequence)
    for length, found_runs in runs.items():
        sizes = np.array([r[0] for r in found_runs])
        plan.ranks[length] = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        plan.sequences[length] = np.array([r[1] for r in found_runs])
        plan.offsets[length] = np.array([r[2] for r in found_runs])
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any others) with ``sequence_id, offset``.

    ``pieces`` is read three times; give a written table.  Pieces of a length
    are ranked in buckets by hash, so a length that many share is dealt over
    many tasks.  Rows that repeat doc_id and piece get a place each; only rows
    equal in all columns may change places when a task runs again.  Columns
    named sequence_id or offset are replaced; names that begin with ``_qw_`` are
    taken.  An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    ws = Workspace(spark, "pack")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    plan = make_plan(histogram, capacity)
    buckets = max(1, int(histogram.sum()) // BUCKET_ROWS)
    rows = pieces.withColumn("_qw_b", F.pmod(F.xxhash64(key_of(), "piece"), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("length", "_qw_b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_qw_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ws.save(sizes.select(F.col("length").alias("_qw_l"), F.col("_qw_b").alias("_qw_c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_qw_base")), "buckets")
    ties = [F.xxhash64(*[F.col(f"`{c}`") for c, t in pieces.dtypes if not t.startswith("map")])]
    rows = rows.withColumn("_qw_r", F.row_number().over(Window.partitionBy("length", "_qw_b").orderBy("doc_id", "piece", *ties)))
    rows = rows.join(sizes, (F.col("length") == F.col("_qw_l")) & (F.col("_qw_b") == F.col("_qw_c"))).withColumn("_qw_r", F.col("_qw_base") + F.col("_qw_r") - 1)
    rows = rows.drop("_qw_b", "_qw_l", "_qw_c", "_qw_base")
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    shared = spark.sparkContext.broadcast(plan)  # runs of places: bounded by the histogram's capacity, not by the rows

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = shared.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["_qw_r"].to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1))
            for i, a in enumerate(edges):
                at = order[a : edges[i + 1] if i + 1 < len(edges) else len(order)]
                n = int(length[at[0]])
                run = np.searchsorted(plan.ranks[n], rank[at], side="right") - 1
                sequence[at] = plan.sequences[n][run] + rank[at] - plan.ranks[n][run]
                offset[at] = plan.offsets[n][run]
            out = batch.drop(columns="_qw_r")
            yield out.assign(sequence_id=sequence, offset=offset)

    return rows.mapInPandas(lean(place), schema)
