"""Vectorised hashing of words and of runs of words (numpy, used inside Arrow tasks)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Text bytes that are hashed at once; a longer text is hashed alone.
SLICE_BYTES = 2 << 20

#: Words over so many bytes are hashed one by one.
LONG_WORD = 256

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Keeps the first 0 to 8 bytes of a little-endian chunk.
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = np.array(x, np.uint64)
    return _mix_into(x, np.empty_like(x))


def _mix_into(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``mix`` in place; ``y`` is overwritten."""
    for turn, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        np.right_shift(x, np.uint64(turn), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint64(factor), out=x)
    np.right_shift(x, np.uint64(31), out=y)
    return np.bitwise_xor(x, y, out=x)


def powers(n: int) -> np.ndarray:
    out = np.full(max(1, n), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of some texts: hash, byte range in ``raw`` and text of each, in order."""

    __slots__ = ("begin", "end", "first", "hash", "raw", "text")

    def __init__(self, texts: list[bytes]):
        self.raw = b" ".join(texts)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.concatenate(([0], np.cumsum(lens + 1)))[: len(texts)]
        b = np.frombuffer(self.raw, np.uint8)
        solid = np.zeros(len(b) + 2, bool)  # neither 9 to 13 nor 32
        np.logical_and(b - np.uint8(9) > 4, b != 0x20, out=solid[1:-1])
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        self.begin, self.end = edge[::2].copy(), edge[1::2].copy()
        # Words before each text, then all of them.
        self.first = np.concatenate((np.searchsorted(self.begin, at), [len(self.begin)]))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        if not len(self.begin):
            self.hash = np.empty(0, np.uint64)
            return
        # Eight bytes of all words at a time.
        padded = self.raw + bytes(8)
        chunks = np.ndarray((len(self.raw) + 1,), np.dtype("<u8"), padded, strides=(1,))
        size = self.end - self.begin
        spare = np.empty(len(size), np.uint64)
        h = _mix_into(size.astype(np.uint64) + _BASE, spare)
        at, left = self.begin, np.minimum(size, LONG_WORD)
        who = slice(None)
        while len(at):
            x = chunks[at] & _FIRST_BYTES[np.minimum(left, 8)]
            x ^= h[who] * _BASE
            h[who] = _mix_into(x, spare[: len(x)])
            more = np.flatnonzero(left > 8)
            at, left = at[more] + 8, left[more] - 8
            who = more if isinstance(who, slice) else who[more]
        for i in np.flatnonzero(size > LONG_WORD):
            h[i] = int.from_bytes(hashlib.blake2b(self.raw[self.begin[i] : self.end[i]], digest_size=8).digest(), "little")
        self.hash = h


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > limit:
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)


def runs(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of ``k`` words within one text, in order."""
    h = words.hash
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c = powers(k + 1)
    acc = h[:n] * c[1]
    for j in range(1, k):
        acc = acc + h[j : j + n] * c[j + 1]
    ok = words.text[:n] == words.text[k - 1 :]
    return mix(acc)[ok], words.text[:n][ok]


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of ``k`` words of each text; of fewer words the whole sequence; none without words."""
    w = Words(texts)
    hashes, owner = runs(w, k)
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        if at[i] < at[i + 1]:
            s = np.sort(hashes[at[i] : at[i + 1]])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            own = w.hash[w.first[i] : w.first[i + 1]]
            if len(own):
                own = mix(np.array([np.sum(own * powers(len(own) + 1)[1:], dtype=np.uint64) + np.uint64(len(own))], np.uint64) ^ np.uint64(0x5DEECE66D))
            out.append(own)
    return out
