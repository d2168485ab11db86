"""64-bit hashes of words, for many texts at once.

A word hashes to the sum of its bytes' table values times powers of an odd base
(modulo 2^64), moved to the base's power 0 and mixed.  Sums of all words of many
texts come from one running sum, so no step loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text that one step hashes, about; a longer text is one step.
STEP = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class WordHasher:
    """Hashes of the words of texts whose words are parted by spaces (0x20) alone."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            with np.errstate(over="ignore"):
                for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
                    factors = np.full(size, np.uint64(base), np.uint64)
                    factors[0] = 1
                    setattr(self, name, np.cumprod(factors))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, number of words of each text)."""
        joined = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        self._powers(len(joined))
        inside = joined != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        first, end = edge[0::2], edge[1::2]
        with np.errstate(over="ignore"):
            sums = np.cumsum(_VALUES[joined] * self.up[: len(joined)])
            h = (sums[end - 1] - sums[first - 1]) * self.down[first]
            h = mix(h + (end - first).astype(np.uint64))
        starts = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        upto = np.searchsorted(first, starts)
        return h, np.diff(upto, prepend=0)


def steps(texts: list[bytes], size: int = STEP) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of texts of about ``size`` bytes."""
    at = 0
    while at < len(texts):
        end, room = at, size
        while end < len(texts) and (end == at or room >= len(texts[end])):
            room -= len(texts[end])
            end += 1
        yield at, end
        at = end
