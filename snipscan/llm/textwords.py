"""Words of many texts at once, as numpy arrays: no Python object per word.

A word is a run of bytes other than the six ASCII white-space characters, so ``[^\\x20\\x09-\\x0D]+`` of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words:
    """Where the words of ``texts`` lie in ``buf``, which holds the texts with a newline after each."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, self.n) + 1
        self.text_end = np.cumsum(lengths)
        self.text_start = self.text_end - lengths
        space = SPACE[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate((np.zeros(1, edge.dtype), edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.text_start, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=self.n)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes, or of its first ``most`` bytes."""
        length = self.end - self.start if most is None else np.minimum(self.end - self.start, most)
        h = length.astype(U64) * U64(0x9E3779B97F4A7C15)
        live = np.arange(len(length))
        for j in range(_LONG):
            live = live[length[live] > j]
            if not len(live):
                break
            h[live] = h[live] * U64(0x100000001B3) + self.buf[self.start[live] + j]
        for i in np.flatnonzero(length > _LONG):
            h[i] = int.from_bytes(hashlib.blake2b(self.buf[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return mix(h)

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word's position, hash) of each window of ``k`` words within a text."""
        m = len(hashes) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.doc[k - 1 :] == self.doc[:m])
        h = np.zeros(len(at), U64)
        for j in range(k):
            h = mix(h * U64(0xD6E8FEB86659FD93) + hashes[at + j])
        return at, h


def as_bytes(texts: pa.Array) -> list[bytes]:
    """The texts in UTF-8; null as the empty text."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is a range of its own."""
    lo = size = 0
    for hi, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield lo, hi
            lo, size = hi, 0
        size += len(x)
    if lo < len(texts):
        yield lo, len(texts)
