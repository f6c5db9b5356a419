"""Words of whole texts as numpy arrays, for use inside Arrow batches.

A word is a longest stretch of bytes other than space and tab to carriage return. The
separators are ASCII, so splitting UTF-8 bytes and splitting code points agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes looked at together while splitting; bounds the temporary arrays.
PIECE = 1 << 20
#: Bytes of text worked on together; a longer text is a slice of its own.
SLICE = 2 << 20

IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.Generator(np.random.PCG64(20_240_601))
_BYTE = _random.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_TERM = np.where(IS_WORD, _BYTE, 0).astype(np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(_BASE, 64)


def power_table(n: int) -> np.ndarray:
    """At least n powers of the byte hash's base."""
    global _POWERS
    if len(_POWERS) < n:
        if n > PIECE:
            return powers(_BASE, n)
        _POWERS = powers(_BASE, 2 * n)
    return _POWERS


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of one row."""
    _, offsets = raw(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, len(texts))
        i = j


@dataclass
class Words:
    """Words in text order: bytes start to end of data, and a 64-bit name of each."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    name: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def split(texts: pa.Array, lower: bool = False, named: bool = True) -> Words:
    """The words of every text; ``lower`` turns A-Z to a-z first."""
    data, offsets = raw(texts)
    if lower:
        data = LOWER[data]
    edge = np.unique(offsets)
    starts, ends, names = [], [], []
    at = 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        while to < len(data) and IS_WORD[data[to]] and IS_WORD[data[to - 1]]:
            # a word must not be cut; a text's edge ends it as a separator does
            stop = np.flatnonzero(~IS_WORD[data[to : to + PIECE]])[:1]
            to = to + int(stop[0]) if len(stop) else min(to + PIECE, len(data))
        part = data[at:to]
        inside = IS_WORD[part]
        cut = np.zeros(len(part) + 1, bool)
        cut[edge[np.searchsorted(edge, at) : np.searchsorted(edge, to, "right")] - at] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | cut[1:-1]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | cut[1:-1]
        s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        if named and len(s):
            length = e - s
            # separators behind a word count nothing, whatever their place
            place = np.arange(s[0], len(part)) - np.repeat(s, np.diff(np.append(s, len(part))))
            terms = _TERM.take(part[s[0] :])
            terms *= power_table(int(length.max())).take(place, mode="clip")
            total = np.add.reduceat(terms, s - s[0])
            names.append(mix(total + length.astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    return Words(
        data, offsets, start, join(ends, np.int64), join(names, np.uint64), np.searchsorted(start, offsets)
    )


def name_of(word: bytes) -> np.uint64:
    """The name that split() gives this word."""
    terms = _BYTE[np.frombuffer(word, np.uint8)] * power_table(len(word))[: len(word)]
    return mix(np.array([terms.sum(dtype=np.uint64)]) + np.uint64(len(word)))[0]
