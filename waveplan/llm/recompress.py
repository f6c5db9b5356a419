"""Recompression of word sequences: rounds that name runs, then pairs, of symbols.

A round first names every longest run of one symbol, then splits the symbols in two halves
by a bit of their name and names every pair (left half, right half). A name is a hash of
what it stands for, so the same run or pair gets the same name in every document, task and
executor, with no dictionary to send around.

Which symbols arise inside a stretch of words depends on the stretch and a little of what
stands beside it. Each symbol carries its extent: the words that settle that it arises. If
the extent lies inside a window, every equal window holds that symbol too. So the highest
symbol whose extent a window contains is a key that all equal windows share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from waveplan.llm.words import mix, powers

ROUNDS = 3
_WORD_BASE = np.uint64(0xD1B54A32D192ED03)
_LEFT, _RIGHT, _RUN = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
_FAR = 1 << 40
_LEVEL_BITS = np.uint64(60)


@dataclass
class Symbols:
    """Symbols in text order; lo to hi (inclusive) are the words that settle each."""

    name: np.ndarray
    doc: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def _beside(s: Symbols) -> tuple[np.ndarray, ...]:
    """Extents of the left and the right neighbour; endless beyond a text's edge."""
    same = s.doc[1:] == s.doc[:-1]
    n = len(s.name)
    lo_l, hi_l, lo_r, hi_r = np.full(n, -_FAR), np.full(n, -_FAR), np.full(n, _FAR), np.full(n, _FAR)
    lo_l[1:] = np.where(same, s.lo[:-1], -_FAR)
    hi_l[1:] = np.where(same, s.hi[:-1], -_FAR)
    lo_r[:-1] = np.where(same, s.lo[1:], _FAR)
    hi_r[:-1] = np.where(same, s.hi[1:], _FAR)
    return lo_l, hi_l, lo_r, hi_r


def runs(s: Symbols) -> Symbols:
    """Name every longest run of one symbol. That a run ends is seen at its neighbours."""
    if not len(s.name):
        return s
    lo_l, _, _, hi_r = _beside(s)
    head = np.ones(len(s.name), bool)
    head[1:] = (s.name[1:] != s.name[:-1]) | (s.doc[1:] != s.doc[:-1])
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(s.name)) - 1
    length = last - at + 1
    name = s.name[at]
    long = length > 1
    name[long] = mix(name[long] * _RUN + length[long].astype(np.uint64))
    return Symbols(name, s.doc[at], np.minimum(lo_l[at], s.lo[at]), np.maximum(hi_r[last], s.hi[last]))


def pairs(s: Symbols) -> Symbols:
    """Name every pair of a left-half symbol and a right-half symbol behind it."""
    if not len(s.name):
        return s
    lo_l, hi_l, lo_r, hi_r = _beside(s)
    left = (s.name >> np.uint64(17)) & np.uint64(1) == 1
    first = np.zeros(len(s.name), bool)
    first[:-1] = left[:-1] & ~left[1:] & (s.doc[1:] == s.doc[:-1])
    second = np.zeros(len(s.name), bool)
    second[1:] = first[:-1]
    # a symbol that stays alone does so because of its right (left half) or left neighbour
    lo = np.where(first | left, np.minimum(s.lo, lo_r), np.minimum(s.lo, lo_l))
    hi = np.where(first | left, np.maximum(s.hi, hi_r), np.maximum(s.hi, hi_l))
    name = s.name.copy()
    i = np.flatnonzero(first)
    name[i] = mix(s.name[i] * _LEFT + mix(s.name[i + 1] * _RIGHT))
    stay = ~second
    return Symbols(name[stay], s.doc[stay], lo[stay], hi[stay])


def stretch_names(word: np.ndarray, width: int) -> np.ndarray:
    """A function of first and last word that names stretches of up to ``width`` words."""
    up = powers(_WORD_BASE, len(word) + width + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * up[: len(word)], dtype=np.uint64)])
    back = powers(np.uint64(pow(int(_WORD_BASE), -1, 1 << 64)), len(word) + 1)

    def name(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((total[hi + 1] - total[lo]) * back[lo] + (hi - lo).astype(np.uint64))

    return name


def anchors(word: np.ndarray, first: np.ndarray, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a window (word index, in order) the key of its highest symbol.

    ``word``: names of all words; ``first``: index of each text's first word, and the end.
    """
    n = len(word)
    index = np.arange(n)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    name = stretch_names(word, window)
    best = [np.zeros(n, np.uint64) for _ in range(window + 1)]
    best[1] = mix(word ^ _RUN) >> np.uint64(4)
    s = Symbols(word, doc, index, index)
    for level in range(1, 2 * rounds + 1):
        s = pairs(s) if level % 2 == 0 else runs(s)
        width = s.hi - s.lo + 1
        fits = np.flatnonzero(width <= window)
        lo, hi, width = s.lo[fits], s.hi[fits], width[fits]
        key = (mix(s.name[fits] ^ name(lo, hi)) >> np.uint64(4)) | (np.uint64(level) << _LEVEL_BITS)
        order = np.argsort(width, kind="stable")
        edges = np.searchsorted(width[order], np.arange(1, window + 2))
        for w in range(1, window + 1):
            own = order[edges[w - 1] : edges[w]]
            # two symbols of one extent: the greater stays, whatever the order
            np.maximum.at(best[w], lo[own], key[own])
    for w in range(2, window + 1):
        here = best[w - 1]
        best[w][:-1] = np.maximum(best[w][:-1], np.maximum(here[:-1], here[1:]))
        best[w - 1] = None
    starts = np.flatnonzero(index + window <= np.repeat(first[1:], counts))
    return starts, best[window][starts]
