"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton over all pieces reads a segment once.  At each position it
reports the pieces that end there by following output links, and each report
relaxes the best way to that position (Viterbi).

* Unigram models: the best way has the largest sum of piece scores.
* BPE models (such as the public 32k file): the sum of scores is not what their
  merges compute, so a report relaxes a position only if the merges would leave
  the piece beside the last piece of the best prefix.  Exactly one piece can
  end the merged form of a prefix, and the result equals the merges'.

Runs of the space mark may tie in score; those segments are merged directly.
Texts are cut before each run of space marks, which no piece crosses, and the
ids of recent segments are remembered.  New segments are cut once more, between
characters that no piece has side by side.
"""

from __future__ import annotations

import functools
import heapq
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

SPACE = "▁"
#: Segments that a task remembers the ids of, at most.
REMEMBERED = 300_000
#: Segments this long are not remembered.
LONG = 100
SEGMENT = regex.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


class PieceModel:
    """Encoder and decoder for the pieces of a model file with the identity normaliser."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only models with the identity normaliser are read")
        self.prefix, self.unigram = spec.add_dummy_prefix, proto.trainer_spec.model_type == UNIGRAM
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.score = {p.piece: p.score for p in proto.pieces if p.type in (NORMAL, USER)}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER)}
        self.automaton = ahocorasick.Automaton()
        ordered = sorted(self.score, key=lambda p: (len(p) > 1, -self.score[p], p))
        #: Pieces in the order of their merges, single characters first, with the two parts of the last merge.
        self.rank = {p: r for r, p in enumerate(ordered)}
        self.name, self.split = ordered, []
        for rank, piece in enumerate(ordered):
            parts = [piece] if len(piece) == 1 or self.unigram else self.merged(piece, stop=True)
            self.split.append((rank, rank) if len(parts) == 1 else tuple(self.rank[p] for p in parts) if len(parts) == 2 else None)
            # a piece that the merges never form is never reported
            if self.split[-1] is not None:
                self.automaton.add_word(piece, (rank, len(piece)))
        self.automaton.make_automaton()
        self.value = [self.score[p] for p in ordered]
        self.beside: dict[int, bool] = {}
        #: Neighbouring characters inside some piece; no piece crosses any other two.
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def merged(self, text: str, stop: bool = False) -> list[str]:
        """The pieces that merging by score leaves: the best pair first, the leftmost of equals.

        ``stop``: the parts before the merge that would form the whole text.
        """
        parts = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (s := self.score.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not parts[i] or after[i] != j or parts[i] + parts[j] != both:
                continue
            if stop and len(both) == len(text):
                break
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges of two pieces side by side leave both.

        Merges are undone from the last one back; at each step no merge across
        the border may come before the one that was undone.
        """
        limit = len(self.name)
        rank, name, split = self.rank, self.name, self.split
        while True:
            if (across := rank.get(name[left] + name[right])) is not None and across < limit:
                return False
            for side in ((0, 1) if left > right else (1, 0)):
                if side == 0 and (inner := split[left][1]) != left:
                    limit, left = left, inner
                    break
                if side == 1 and (inner := split[right][0]) != right:
                    limit, right = right + 1, inner
                    break
            else:
                return True

    def relax(self, part: str) -> list[str]:
        """Pieces of a part by one pass over the automaton's reports.

        A part is one character that no piece covers, or has none such.
        """
        last: list[int | None] = [-1] + [None] * len(part)
        if self.unigram:
            best = [0.0] + [-np.inf] * len(part)
            for at, (piece, length) in self.automaton.iter(part):
                if (s := best[at + 1 - length] + self.value[piece]) > best[at + 1]:
                    best[at + 1], last[at + 1] = s, piece
        else:
            beside = self.beside
            for at, (piece, length) in self.automaton.iter(part):
                if last[at + 1] is None:
                    before = last[at + 1 - length]
                    if before < 0:
                        last[at + 1] = piece
                        continue
                    if (good := beside.get(key := before << 20 | piece)) is None:
                        if len(beside) > 4 * REMEMBERED:
                            beside.clear()
                        good = beside[key] = self.fits(before, piece)
                    if good:
                        last[at + 1] = piece
        out, at = [], len(part)
        while at:
            out.append(part[at - 1] if last[at] is None else self.name[last[at]])
            at -= len(out[-1])
        return out[::-1]

    def part_ids(self, part: str) -> bytes:
        """Ids of a part that no piece crosses the ends of."""
        ids: list[int] = []
        direct = not self.unigram and (part.startswith(SPACE * 2) or part == SPACE)
        for piece in self.merged(part) if direct else self.relax(part):
            if (i := self.ids.get(piece)) is not None:
                ids.append(i)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in piece.encode())
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return struct.pack(f"<{len(ids)}I", *ids)

    def segment_ids(self, segment: str) -> bytes:
        """Ids of a segment, part by part: it is cut between characters that no piece has side by side."""
        inside, parts, out, start = self.inside, self.parts, [], 0
        if len(parts) > REMEMBERED:
            parts.clear()
        for end in range(1, len(segment) + 1):
            if end < len(segment) and (segment[end - 1 : end + 1] in inside or not self.bytes):
                continue
            part = segment[start:end]
            if (ids := parts.get(part)) is None:
                ids = self.part_ids(part)
                if len(part) < LONG:
                    parts[part] = ids
            out.append(ids)
            start = end
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers; an empty text has none."""
        if not text:
            return b""
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        known, out = self.known, []
        for segment in SEGMENT.findall(text):
            if (ids := known.get(segment)) is None:
                if len(known) > REMEMBERED:
                    known.clear()
                ids = self.segment_ids(segment)
                if len(segment) < LONG:
                    known[segment] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, control pieces nothing."""
        out, held = [], bytearray()
        for i in np.frombuffer(ids, "<u4").tolist():
            if self.kinds[i] == BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif self.kinds[i] != CONTROL:
                out.append(self.pieces[i])
        out.append(held.decode("utf-8", "replace"))
        text = "".join(out)
        if self.prefix and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


@functools.cache
def piece_model(path: str) -> PieceModel:
    """One model a Python worker, so that tasks that follow each other share what it remembers."""
    return PieceModel(path)


ENCODED = "ids binary, decoded string"


def encode_texts(docs: DataFrame, model_path: str, decode: bool = True) -> DataFrame:
    """``doc_id, ids, decoded`` of every whole text; a null text has no ids and decodes to the empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_model(model_path)
        for batch in batches:
            ids = [model.encode(t or "") for t in batch["text"]]
            texts = [model.decode(i) for i in ids] if decode else [None] * len(ids)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "ids": ids, "decoded": pd.Series(texts, dtype=object)})

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(run, "doc_id long, " + ENCODED)
