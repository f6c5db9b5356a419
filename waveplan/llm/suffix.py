"""Suffix trees of symbol lists, and the longest common extension of any two places.

The tree is built online (Ukkonen). A tour of it in symbol order gives the rank of every
suffix, and the depth of the node where the tour turns between two neighbouring leaves. The
lowest common ancestor of two leaves is the shallowest turn between them; a table of minima
over stretches of 2 ** k turns answers that with two lookups, for whole arrays of questions.
"""

from __future__ import annotations

import numpy as np

#: Stands behind the last symbol; smaller than all of them.
END = -1


def build(symbols: list[int]) -> tuple[list[int], list[int], list[dict | None]]:
    """Start and end of the label above each node, and its children by first symbol; leaves have
    none. Node 0 is the root; ``symbols`` must end with END."""
    n = len(symbols)
    start, end, link, child = [0], [0], [0], [{}]
    node = edge = length = pending = 0
    for i, symbol in enumerate(symbols):
        pending += 1
        above = 0
        while pending:
            if not length:
                edge = i
            kids = child[node]
            below = kids.get(symbols[edge])
            if below is None:
                kids[symbols[edge]] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                child.append(None)
                if above:
                    link[above] = node
                    above = 0
            else:
                size = end[below] - start[below]
                if child[below] is not None and length >= size:
                    node = below
                    edge += size
                    length -= size
                    continue
                at = start[below] + length
                if symbols[at] == symbol:
                    length += 1
                    if above:
                        link[above] = node
                    break
                middle = len(start)
                kids[symbols[edge]] = middle
                start += (start[below], i)
                end += (at, n)
                link += (0, 0)
                child += ({symbols[at]: below, symbol: middle + 1}, None)
                start[below] = at
                if above:
                    link[above] = middle
                above = middle
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - pending + 1
    return start, end, child


def tour(tree: tuple[list[int], list[int], list[dict | None]], falling: bool = False) -> tuple[list[int], list[int]]:
    """Suffixes in the order of the tour, and the depth of the turn after each but the last.

    ``falling`` visits larger symbols first, but the end still before all symbols.
    """
    start, end, child = tree
    order, turns = [], []
    waiting = [(0, 0, 0)]
    while waiting:
        node, depth, turn = waiting.pop()
        if child[node] is None:
            if order:
                turns.append(turn)
            order.append(start[node] - depth)
            continue
        depth += end[node] - start[node]
        kids = child[node]
        # what is put there last is visited first
        ranked = sorted(kids, reverse=not falling)
        if falling and ranked[0] == END:
            ranked = ranked[1:] + ranked[:1]
        last = len(ranked) - 1
        for k, symbol in enumerate(ranked):
            # the first child visited comes after the turn of its parent
            waiting.append((kids[symbol], depth, turn if k == last else depth))
    return order, turns


class Extensions:
    """How far the symbols from two places on agree."""

    def __init__(self, symbols: list[int]):
        self.n = len(symbols)
        self.tree = build([*symbols, END])
        order, turns = tour(self.tree)
        self.rank = np.empty(self.n + 1, np.int64)
        self.rank[order] = np.arange(self.n + 1)
        self.least = [np.array(turns, np.int32)]
        while 2 ** len(self.least) <= self.n:
            low, half = self.least[-1], 2 ** (len(self.least) - 1)
            self.least.append(np.minimum(low[:-half], low[half:]))

    def falling_rank(self) -> np.ndarray:
        """Ranks of the suffixes when larger symbols come first."""
        rank = np.empty(self.n + 1, np.int64)
        rank[tour(self.tree, True)[0]] = np.arange(self.n + 1)
        return rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common symbols from a and from b on; both differ, and may be one behind the last."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        out = np.zeros(len(low), np.int64)
        level = np.floor(np.log2(np.maximum(high - low, 1))).astype(np.int64)
        for k in np.unique(level):
            own = level == k
            table = self.least[k]
            out[own] = np.minimum(table[low[own]], table[high[own] - 2**k])
        return out
