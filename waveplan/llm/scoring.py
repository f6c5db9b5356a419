"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A token (word, or the end of a text) is coded byte by byte and a stop byte, each byte as
eight binary choices. For each choice five predictors look up how often 0 and 1 came after
their context in the training tokens: the last one to four bytes and all bytes of the token
so far, each hashed with the bits already known into a table of fixed size. A gate, chosen by
how much the two longest contexts have seen and by the place of the bit, picks the weights
that mix the predictions in the logistic domain; a map refines the result. Weights, map and
shares are learned from all training tokens, each as if it were new (its own count taken
out): every bucket of distinct tokens learns weights block by block from the same start, and
the buckets' weights are averaged by how much each has seen (its curvature). Last, the token's
share of the training tokens of documents like this one is mixed in: a mixture of unigrams,
fitted without labels on all training documents, sorts them into ``CLASSES`` classes, and
inside a text the belief in each class adapts online with every token read. The mixture
starts from clusters in the directions in which the documents' words vary most.

Those contexts end at the token, so this probability is computed once for each distinct
token, not for each of its occurrences. What stands before a token comes in along the text:
four predictions of each occurrence are mixed, that one, the training count of the token
after its predecessor, and how often token and pair came up in the text so far. A gate (how
often the predecessor was seen, how far the text has come) picks the logits of their
weights, which every text starts from ``START`` and moves by the error after each ``BLOCK``
tokens, so that each token is predicted from the ones before it alone. Pairs are counted over
all training documents; a training text is scored without its own pairs.

Distinct tokens, pairs and their training counts are gathered from all documents: chunks
of documents send what they hold to buckets in one pass over their texts, buckets count, score and answer in the order
in which the chunk asked (see chunks.py). Pairs go by their bucket and 32 bits of a hash,
with as many pairs in a bucket at every size. The bit tables are sums over all distinct
training tokens. Only sums of fixed size go through the driver; they are sums of integers, so
the model does not depend on how rows are dealt to tasks.

``score`` is the log10 probability of the token sequence, ``bits_per_byte`` the same in bits
over the tokens' bytes, stop bytes included. Defined results: a null or empty text is one
end token; a null id counts as remainder 0 (training); rows of one id are texts of their own;
with no training token every bit has probability 1/2; an empty table gives an empty table.
Tokens are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveplan.llm import chunks
from waveplan.llm.store import Run, part_of, read
from waveplan.llm.words import Words, mix, name_of, powers, slices, split

BITS = 19
ORDERS = 5
#: Text of a chunk and, of all tokens, of a bucket; they bound what a task holds.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20
#: Buckets whose tokens one task adds up in its tables.
BUCKETS_A_TABLE = 32
HELD_OUT = 1
CLASSES = 4
#: Text of a bucket of pairs.
PAIR_BYTES = 16 << 20
#: Tokens of a text that are scored with the same weights, and the step of these.
BLOCK = 64
RATE = 0.03
_SEEN = (1, 4, 32, 1024)
_FAR = (64, 1024)
#: Logits of the weights in each gate (predecessor seen, place in the text) at a text's start.
START = np.array(
    [[(0.0, after, near, -2.0) for near in (-3.5, -3.0, -2.5)] for after in (0.0, -1.5, -0.5, 0.3, 0.8)]
).reshape(-1, 4)
_PAIR = np.uint64(0xE7037ED1A0B428DB)
CLASS_BITS = 12
#: Rounds of the mixture of unigrams at most; it ends when a round moves less than this share of the words.
ROUNDS = 20
MOVED = 1e-3
END = b"\n"
_STOP = 0
_DELTA = 0.3
_DRAW = 1000.0
_MAP = 33
_AT_ONCE = 1 << 16
#: Bytes of text that are cut into tokens together.
_TOGETHER = 1 << 19
#: Gates of the bit predictors, and what their weights are at the start.
_GATES = 8 * 16
_WEIGHT = 0.3
#: How much of what is seen the start counts for: in the weights, and in each place of the map.
_RIDGE, _TRUST = 10.0, 50.0
#: Bytes that a bucket learns from before its weights move first; doubled with each block.
_FIRST = 1 << 11
#: Share of the counts among tokens known and by bits: log2 of their ratio is counted in so many bins a unit.
_RATIO, _BINS = 64, 16
#: Fixed point of what tasks add up.
_UNIT = 1024
_BITS = np.eye(2, dtype=np.float32)
#: Log of a probability that is a number still.
_LEAST = -650.0
#: Groups of word slots whose covariance is summed, and cells of a direction.
_GROUPS, _CELLS = 256, 16
_RESULT = (
    "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"
)


def code(lengths: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens with a stop byte each, hashes of their five contexts, their token."""
    full = lengths + 1
    ends = np.cumsum(full)
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    token = np.repeat(np.arange(len(full)), full)
    place = np.arange(len(data)) - np.repeat(ends - full, full)
    inside = np.ones(len(data), bool)
    inside[ends - 1] = False
    data[inside] = body
    data[ends - 1] = _STOP
    context = np.empty((ORDERS, len(data)), np.uint64)
    h = np.zeros(len(data), np.uint64)
    for order in range(1, ORDERS):
        before = np.zeros(len(data), np.uint64)
        before[order:] = data[:-order].astype(np.uint64) + np.uint64(1)
        before[place < order] = 0
        h = h * np.uint64(257) + before
        context[order - 1] = mix(h + (np.uint64(order) << np.uint64(48)))
    up = powers(np.uint64(0x9E3779B97F4A7C15), int(full.max()) if len(full) else 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(data + np.uint64(1)) * up[place], dtype=np.uint64)])
    context[ORDERS - 1] = mix(total[:-1] - total[np.repeat(ends - full, full)] + place.astype(np.uint64))
    return data, context, token


def choices(data: np.ndarray, context: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the eight bits: node in the byte, the bit, a slot for each predictor."""
    shift = np.uint64(64 - BITS)
    for k in range(8):
        node = (np.uint16(1) << np.uint16(k)) | (data.astype(np.uint16) >> np.uint16(8 - k))
        bit = (data >> np.uint8(7 - k)) & np.uint8(1)
        salt = (node.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
        yield node, bit, ((context * salt[None, :]) >> shift).astype(np.int32)


def tables(lengths: np.ndarray, body: np.ndarray, counts: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """How often each predictor's slots saw 0 and 1, over tokens with counts; added to ``out``."""
    out = np.zeros((ORDERS, 2 << BITS)) if out is None else out
    ends = np.concatenate([[0], np.cumsum(lengths)])
    for a, b in _parts(lengths, _AT_ONCE):
        data, context, token = code(lengths[a:b], body[ends[a] : ends[b]])
        weight = counts[a:b][token].astype(float)
        for _, bit, slot in choices(data, context):
            for i in range(ORDERS):
                np.add.at(out[i], slot[i] * 2 + bit, weight)
    return out


def _parts(lengths: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of tokens of about ``size`` bytes, or of one token."""
    ends = np.cumsum(lengths + 1)
    a = 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield a, b
        a = b


def _stretch(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Log odds of a 1 after these counts."""
    return np.log(one + _DELTA) - np.log(zero + _DELTA)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def _seen(n: np.ndarray) -> np.ndarray:
    """0: never, then 1, a few, many."""
    return (n > 0.5).astype(np.uint8) + (n > 1.5) + (n > 20.5)


def by_gate(seen_long: np.ndarray, seen_most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of one place in their bytes in the order of the place's 16 gates, and where each gate begins."""
    gate = seen_long * np.uint8(4) + seen_most
    order = np.argsort(gate, kind="stable")
    return order, np.searchsorted(gate[order], np.arange(17))


def mixed(weights: np.ndarray, inputs: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Log odds of a 1, from the gates' weights and inputs in the order of gates."""
    x = np.empty(inputs.shape[1], np.float32)
    for g in range(16):
        if cut[g] < cut[g + 1]:
            x[cut[g] : cut[g + 1]] = weights[g].astype(np.float32) @ inputs[:, cut[g] : cut[g + 1]]
    return x


@dataclass
class Mixer:
    """Predictions and what they are based on, weights by gate, the adaptive map."""

    stretch: np.ndarray
    seen: np.ndarray
    weights: np.ndarray
    refine: np.ndarray
    share: float
    total: float

    def bit_probability(self, x: np.ndarray, node: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Of each bit, from its mixed log odds and the map."""
        at = (np.clip(x, -8, 8) + 8) * ((_MAP - 1) / 16)
        low = np.minimum(at.astype(np.int32), _MAP - 2)
        spot, rest, flat = node.astype(np.int32) * _MAP + low, at - low, self.refine.ravel()
        refined = flat.take(spot) * (1 - rest) + flat.take(spot + 1) * rest
        one = np.clip(0.5 * _squash(x) + 0.5 * refined, 1e-6, 1 - 1e-6)
        return np.where(bit, one, 1 - one)

    def log2_of_bits(self, lengths: np.ndarray, body: np.ndarray) -> np.ndarray:
        """log2 probability of each token by its bits alone."""
        out = np.zeros(len(lengths))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        for a, b in _parts(lengths, _AT_ONCE):
            data, context, token = code(lengths[a:b], body[ends[a] : ends[b]])
            p, inputs = np.ones(len(data)), np.ones((ORDERS + 1, len(data)), np.float32)
            for k, (node, bit, slot) in enumerate(choices(data, context)):
                for i in range(ORDERS):
                    self.stretch[i].take(slot[i], out=inputs[i], mode="clip")
                seen = [self.seen[i].take(slot[ORDERS - 2 + i]) for i in (0, 1)]
                order, cut = by_gate(*seen)
                x = mixed(self.weights[k * 16 : k * 16 + 16], inputs.take(order, 1), cut)
                p[order] *= self.bit_probability(x, node[order], bit[order])
            out[a:b] = np.bincount(token, np.log2(p), b - a)
        return out

    def known(self, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Probability of each token (row) in each class, drawn to its probability in all."""
        whole = counts.sum(1, keepdims=True) / max(float(totals.sum()), 1.0)
        return (counts + _DRAW * whole) / (totals + _DRAW)


def adapt(log_known: np.ndarray, first: np.ndarray, log_prior: np.ndarray) -> np.ndarray:
    """Belief in each class before each token of each text, from the tokens before it."""
    log_known = np.ascontiguousarray(log_known.T)
    before = np.zeros(log_known.shape)
    np.cumsum(log_known[:, :-1], 1, out=before[:, 1:])
    n = np.diff(first)
    before -= np.repeat(before[:, first[:-1][n > 0]], n[n > 0], 1)
    before += log_prior[:, None]
    before -= before.max(0)
    belief = np.exp(before, out=before)
    belief /= belief.sum(0)
    return belief.T


def _class_slot(name: np.ndarray) -> np.ndarray:
    return (name >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


@dataclass
class Profiles:
    """Word slots of some texts and how often each stands there; texts without a word are left out."""

    first: np.ndarray
    slot: np.ndarray
    count: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(self.slot))))

    def shares(self) -> np.ndarray:
        """Each text as a vector of fixed length: roots of the shares of groups of slots, in fixed point."""
        group = self.doc * _GROUPS + (self.slot >> (CLASS_BITS - 8))
        table = np.bincount(group, self.count, len(self.first) * _GROUPS).reshape(-1, _GROUPS)
        return np.rint(_UNIT * np.sqrt(table / table.sum(1, keepdims=True)))


def profiles(texts: pa.Array) -> Iterator[Profiles]:
    for i, j in slices(texts):
        words = split(texts.slice(i, j - i), lower=True)
        if len(words.name):
            key = np.sort((words.doc << CLASS_BITS) | _class_slot(words.name))
            at = chunks.heads(key)
            key, count = key[at], np.diff(np.append(at, len(key)))
            yield Profiles(chunks.heads(key >> CLASS_BITS), key & ((1 << CLASS_BITS) - 1), count)


def moments(own: Profiles) -> np.ndarray:
    """Products of the shares of all pairs of groups, their sums, the number of texts."""
    x = own.shares()
    return np.concatenate([(x.T @ x).ravel(), x.sum(0), [len(x)]])


@dataclass
class Directions:
    """The directions in which texts vary most, scaled to variance 1."""

    centre: np.ndarray
    axes: np.ndarray

    @classmethod
    def of(cls, sums: np.ndarray, kinds: int) -> Directions:
        n, sums = sums[-1], sums.astype(float)
        centre = sums[_GROUPS**2 : -1] / n
        size, axes = np.linalg.eigh(sums[: _GROUPS**2].reshape(_GROUPS, -1) / n - np.outer(centre, centre))
        axes = axes[:, ::-1][:, : kinds - 1]
        axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(kinds - 1)])
        return cls(centre, axes / np.sqrt(np.maximum(size[::-1][: kinds - 1], 1e-9)))

    def at(self, own: Profiles) -> np.ndarray:
        return (own.shares() - self.centre) @ self.axes

    def cells(self, own: Profiles) -> np.ndarray:
        """How many texts are in each cell of a grid from -3 to 3 in each direction."""
        spot = np.clip(np.floor((self.at(own) + 3) * (_CELLS / 6)), 0, _CELLS - 1).astype(np.int64)
        spot = spot @ (_CELLS ** np.arange(spot.shape[1]))
        return np.bincount(spot, minlength=_CELLS ** self.axes.shape[1])

    def clusters(self, cells: np.ndarray, kinds: int) -> np.ndarray:
        """Centres of the texts in the grid, started from full cells far from those picked before."""
        full = np.flatnonzero(cells)
        place = full[:, None] // (_CELLS ** np.arange(self.axes.shape[1])) % _CELLS
        place, weight = (place + 0.5) * (6 / _CELLS) - 3, cells[full].astype(float)
        far = lambda centres: ((place[:, None] - centres[None]) ** 2).sum(-1)
        centres = place[[weight.argmax()]]
        while len(centres) < kinds:
            centres = np.concatenate([centres, place[[(far(centres).min(1) * weight).argmax()]]])
        for _ in range(ROUNDS):
            near = far(centres).argmin(1)
            for k in range(kinds):
                if weight[near == k].sum() > 0:
                    centres[k] = np.average(place[near == k], 0, weight[near == k])
        return centres


def _sums(own: Profiles, belief: np.ndarray) -> np.ndarray:
    """Words of each slot and texts in each class, and the words, in fixed point."""
    doc, part, size = own.doc, np.rint(_UNIT * belief), 1 << CLASS_BITS
    words = [np.bincount(own.slot, own.count * part[doc, k], size) for k in range(belief.shape[1])]
    return np.concatenate([np.stack(words, 1).ravel(), part.sum(0)])


def clustered(own: Profiles, directions: Directions, centres: np.ndarray) -> np.ndarray:
    """What the classes hold if each text belongs to the nearest centre."""
    near = ((directions.at(own)[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
    return _sums(own, np.eye(len(centres))[near])


def believed(own: Profiles, logs: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """What the classes hold if each text belongs to them as they explain it."""
    score = np.add.reduceat(logs[own.slot] * own.count[:, None], own.first) + prior
    belief = np.exp(np.clip(score - score.max(1, keepdims=True), -50, 0))
    return _sums(own, belief / belief.sum(1, keepdims=True))


def fit_classes(add_up, kinds: int) -> np.ndarray:
    """log probabilities of word slots in each class, by a mixture of unigrams over all texts.

    ``add_up(function, size)`` is the sum of ``function(profiles)``, an array of that size, over all texts.
    """
    size = 1 << CLASS_BITS
    total = add_up(moments, _GROUPS**2 + _GROUPS + 1)
    if total[-1] < kinds:
        return np.zeros((size, 1), np.float32)
    directions = Directions.of(total, kinds)
    centres = directions.clusters(add_up(directions.cells, _CELLS ** (kinds - 1)), kinds)
    sums = add_up(partial(clustered, directions=directions, centres=centres), (size + 1) * kinds)
    for last in range(ROUNDS):
        words, texts = sums[: size * kinds].reshape(size, kinds) / _UNIT, sums[size * kinds :] / _UNIT
        logs = np.log((words + 0.1) / (words.sum(0) + 0.1 * size)).astype(np.float32)
        if last == ROUNDS - 1:
            break
        prior = np.log(texts / total[-1] + 1e-3)
        before, sums = sums, add_up(partial(believed, logs=logs.astype(float), prior=prior), (size + 1) * kinds)
        if np.abs(sums - before)[: size * kinds].sum() < MOVED * sums[: size * kinds].sum():
            break
    return logs


def classes(texts: list[str], kinds: int) -> np.ndarray:
    """The classes of texts at hand."""
    held = list(profiles(pa.array(texts, pa.string())))
    return fit_classes(lambda function, size: sum((function(own).astype(np.int64) for own in held), np.zeros(size, np.int64)), kinds)


def _blocks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of tokens, of ``_FIRST`` bytes and then more and more, up to ``_AT_ONCE``, or of one token."""
    ends = np.cumsum(lengths + 1)
    a, size = 0, _FIRST
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield a, b
        a, size = b, min(2 * size, _AT_ONCE)


#: Curvature and curvature times weights of each gate; the map: ones and all; known tokens by their ratio, unknown ones.
_PARTS = (_GATES * (ORDERS + 1) ** 2, _GATES * (ORDERS + 1), 256 * _MAP, 256 * _MAP, 2 * _RATIO * _BINS + 1)


def without_own(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of a 1 in each slot, and the gates of the two longest contexts, for a bit that is 0 or 1 and not counted itself."""
    odds, seen = np.empty(table.shape, np.float32), np.empty((2, table.shape[1]), np.uint8)
    for i, pairs in enumerate(table.reshape(ORDERS, -1, 2)):
        for bit in (0, 1):
            n = np.maximum(pairs - _BITS[bit], 0)
            if i >= ORDERS - 2:
                seen[i - ORDERS + 2, bit::2] = _seen(n[:, 0] + n[:, 1])
            n = np.log(n + np.float32(_DELTA))
            odds[i, bit::2] = n[:, 1] - n[:, 0]
    return odds, seen


def learn(
    table: np.ndarray,
    lengths: np.ndarray,
    body: np.ndarray,
    counts: np.ndarray,
    weight: np.ndarray,
    total: int,
    own_odds: tuple[np.ndarray, np.ndarray] | None = None,
) -> np.ndarray:
    """What training tokens teach, in fixed point: see ``_PARTS``.

    ``counts``: training counts, ``weight``: occurrences to learn from, ``total``: all training tokens, ``own_odds``:
    :func:`without_own` of the table, if at hand. Each block moves the weights by its gradient
    over the curvature up to its end, where that of an upper bound of the logistic loss (Jaakkola and Jordan) stands for the loss's own.
    """
    odds, gates = without_own(table) if own_odds is None else own_odds
    weights, eye = np.full((_GATES, ORDERS + 1), _WEIGHT), _RIDGE * np.eye(ORDERS + 1)
    weights[:, -1] = 0
    curve = np.zeros((_GATES, ORDERS + 1, ORDERS + 1))
    seen_bits, ratio = np.zeros((256 * _MAP, 2)), np.zeros(_PARTS[-1])
    ends = np.concatenate([[0], np.cumsum(lengths)])
    for a, b in _blocks(lengths):
        data, context, token = code(lengths[a:b], body[ends[a] : ends[b]])
        times, log2 = weight[a:b][token].astype(np.float32), np.zeros(len(data), np.float32)
        inputs = np.ones((ORDERS + 1, len(data)), np.float32)
        for k, (node, bit, slot) in enumerate(choices(data, context)):
            slot = slot * 2 + bit
            for i in range(ORDERS):
                odds[i].take(slot[i], out=inputs[i], mode="clip")
            order, cut = by_gate(*(gates[i].take(slot[ORDERS - 2 + i]) for i in (0, 1)))
            x_in, own, hit, spot = inputs.take(order, 1), times[order], bit[order], node[order].astype(np.int64)
            x = mixed(weights[k * 16 : k * 16 + 16], x_in, cut)
            p = _squash(x)
            # the map counts what came of each place
            at = (np.clip(x, -8, 8) + 8) * ((_MAP - 1) / 16)
            low = np.minimum(at.astype(np.int64), _MAP - 2)
            place = (spot * _MAP + low) * 2 + hit
            whole, upper = (np.bincount(place, part, 512 * _MAP).reshape(-1, 2) for part in (own, (at - low).astype(np.float32) * own))
            seen_bits += whole - upper
            seen_bits[1:] += upper[:-1]
            log2[order] += np.log2(np.clip(np.where(hit, p, 1 - p), 1e-6, 1))
            slope, far = (hit - p) * own, np.maximum(np.abs(x), 1e-3)
            bend = np.tanh(far / 2) / (2 * far) * own
            for g in range(16):
                if cut[g] < cut[g + 1]:
                    part, at_gate = x_in[:, cut[g] : cut[g + 1]], k * 16 + g
                    curve[at_gate] += (part * bend[cut[g] : cut[g + 1]]) @ part.T
                    weights[at_gate] += np.linalg.solve(curve[at_gate] + eye, part @ slope[cut[g] : cut[g + 1]])
        spelled = np.bincount(token, log2, b - a)
        known = np.maximum(counts[a:b] - 1, 0) / max(total - 1, 1)
        with np.errstate(divide="ignore"):
            bins = np.clip(np.rint((np.log2(known) - spelled + _RATIO) * _BINS), 0, _PARTS[-1] - 2)
        bins = np.where(known > 0, bins, _PARTS[-1] - 1).astype(np.int64)
        ratio += np.bincount(bins, weight[a:b], _PARTS[-1])
    moved = (curve @ weights[:, :, None])[..., 0]
    return np.rint(np.concatenate([_UNIT * curve.ravel(), _UNIT * moved.ravel(), _UNIT * seen_bits[:, 1], _UNIT * seen_bits.sum(1), ratio]))


def taught(table: np.ndarray, sums: np.ndarray, total: int) -> Mixer:
    """The mixer from what all buckets have learned."""
    curve, moved, one, every, ratio = np.split(sums.astype(float), np.cumsum(_PARTS)[:-1])
    start = np.full((_GATES, ORDERS + 1), _WEIGHT)
    start[:, -1] = 0
    curve = curve.reshape(_GATES, ORDERS + 1, ORDERS + 1) / _UNIT + _RIDGE * np.eye(ORDERS + 1)
    weights = np.linalg.solve(curve, (moved.reshape(_GATES, -1) / _UNIT + _RIDGE * start)[..., None])[..., 0]
    levels = np.tile(_squash(np.linspace(-8, 8, _MAP)), (256, 1))
    one, every = (x.reshape(256, _MAP) / _UNIT for x in (one, every))
    refine = np.clip((_TRUST * levels + one) / (_TRUST + every), 1e-5, 1 - 1e-5)
    share, odds = 0.5, np.append(2.0 ** (np.arange(_PARTS[-1] - 1) / _BINS - _RATIO), 0.0)
    for _ in range(30 if ratio.sum() else 0):  # expectation-maximisation of the two shares
        share = float(np.clip((ratio * (share * odds / (share * odds + 1 - share))).sum() / ratio.sum(), 0.01, 0.99))
    zero, ones = (table[:, k::2].astype(np.float32) for k in (0, 1))
    seen = np.stack([_seen((zero + ones)[i]) for i in (ORDERS - 2, ORDERS - 1)])
    return Mixer(_stretch(zero, ones), seen, weights.astype(np.float32), refine.astype(np.float32), share, float(total))


def train(table: np.ndarray, tokens: list[tuple[bytes, int]], total: int) -> Mixer:
    """The mixer that tokens at hand teach, each once, with its training count."""
    lengths, body = np.array([len(w) for w, _ in tokens], np.int64), np.frombuffer(b"".join(w for w, _ in tokens), np.uint8)
    counts = np.array([c for _, c in tokens], np.int64)
    return taught(table, learn(table.astype(np.float32), lengths, body, counts, np.ones(len(tokens), np.int64), total), total)


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _ragged(lengths: np.ndarray, body: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The tokens' bytes in another order."""
    begin = np.cumsum(lengths) - lengths
    size = lengths[order]
    shift = np.repeat(begin[order] - (np.cumsum(size) - size), size)
    return body[np.arange(len(shift)) + shift]


def _messages(key: tuple, bucket: np.ndarray, cut: list[int], bodies: list) -> pa.Table:
    return pa.table(
        {
            "bucket": pa.array(bucket, pa.int64()),
            "chunk": pa.array([key[0].as_py()] * len(bucket), pa.int64()),
            "n": pa.array(np.diff(cut), pa.int64()),
            "body": pa.array(bodies, pa.list_(pa.binary())),
        }
    )


def _send(buckets: int, pair_buckets: int, logs: np.ndarray):
    """Messages of a chunk from one pass over its texts. Kind 0: distinct tokens, with name, count in training
    documents by class, and bytes; kind 1: distinct pairs."""
    kinds, send_pairs = logs.shape[1], _send_pairs(pair_buckets)

    def send(key: tuple, table: pa.Table) -> pa.Table:
        texts, learns = _column(table, "text"), ~np.array(_column(table, "held_out").to_pylist(), bool)
        ends, parts, ended = np.zeros(kinds, np.int64), [], []
        for i, j in slices(texts, limit=_TOGETHER):
            words = split(texts.slice(i, j - i), lower=True)
            ended.append(_with_ends(words))
            total = np.concatenate([np.zeros((1, kinds)), np.cumsum(logs[_class_slot(words.name)], 0, dtype=float)])
            kind = (total[words.first[1:]] - total[words.first[:-1]]).argmax(1)
            ends += np.bincount(kind[learns[i:j]], minlength=kinds)
            if not len(words.name):
                continue
            order = np.argsort(words.name, kind="stable")
            at = chunks.heads(words.name[order])
            doc = words.doc[order]
            which = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
            own = learns[i:j][doc]
            count = np.bincount(which[own] * kinds + kind[doc[own]], minlength=len(at) * kinds).reshape(-1, kinds)
            first = order[at]
            size = words.end[first] - words.start[first]
            shift = np.repeat(words.start[first] - (np.cumsum(size) - size), size)
            parts.append((words.name[first], count, size, words.data[np.arange(len(shift)) + shift]))
        parts.append((np.array([name_of(END)]), ends[None], np.array([len(END)]), np.frombuffer(END, np.uint8)))
        name, count, size, body = _merged(*(np.concatenate(x) for x in zip(*parts)))
        bucket = chunks.bucket_of(name, buckets)
        at = chunks.heads(bucket)
        cut = [*at.tolist(), len(name)]
        spot = np.concatenate([[0], np.cumsum(size)])
        count, size = count.astype(np.int32), size.astype(np.int32)
        bodies = [
            [*[x[a:b].tobytes() for x in (name, count, size)], body[spot[a] : spot[b]].tobytes()] for a, b in zip(cut, cut[1:])
        ]
        sent = [_messages(key, bucket[at], cut, bodies), send_pairs(key, table, _joined(ended))]
        return pa.concat_tables([x.append_column("kind", pa.array([k] * len(x), pa.int32())) for k, x in enumerate(sent)])

    return send


def _merged(name, count, size, body):
    """Sorted by name, counts of one token added up."""
    order = np.argsort(name, kind="stable")
    at = chunks.heads(name[order])
    first = order[at]
    return name[first], np.add.reduceat(count[order], at) if len(at) else count, size[first], _ragged(size, body, first)


def _opened(bodies: list, kind: type = np.int32) -> list[np.ndarray]:
    """Names, counts by class, lengths and bytes; chunks send 32-bit counts, buckets hold 64."""
    kinds = [np.uint64, kind, np.int32, np.uint8]
    name, count, size, body = (
        np.concatenate([np.frombuffer(b[i], k) for b in bodies]) if bodies else np.zeros(0, k) for i, k in enumerate(kinds)
    )
    return [name, count.reshape(len(name), -1) if len(name) else count.reshape(0, 1), size, body]


def _count(key: tuple, table: pa.Table) -> pa.Table:
    """The tokens of a bucket, each once, with its training counts."""
    name, count, size, body = _opened(table["body"].to_pylist())
    name, count, size, body = _merged(name, count.astype(np.int64), size, body)
    row = [x.tobytes() for x in (name, count, size.astype(np.int32), body)]
    return pa.table(
        {
            "bucket": [key[0].as_py()],
            "known": [int((count.sum(1) > 0).sum())],
            "tokens": pa.array([count.sum(0).tolist()], pa.list_(pa.int64())),
            "body": pa.array([row], pa.list_(pa.binary())),
        }
    )


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bit tables over all tokens of the task, in slices that can be added apart."""
    out = None
    for batch in batches:
        for row in batch["body"].to_pylist():
            _, count, size, body = _opened([row], np.int64)
            count = count.sum(1)
            keep = np.flatnonzero(count > 0)
            out = tables(size[keep].astype(np.int64), _ragged(size, body, keep), count[keep], out)
    if out is not None:
        yield chunks.sliced(out)


def _learn(table: np.ndarray, total: int):
    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the training tokens of the task's buckets teach, each bucket for itself."""
        out = own_odds = None
        for batch in batches:
            for row in batch["body"].to_pylist():
                _, count, size, body = _opened([row], np.int64)
                count = count.sum(1)
                keep = np.flatnonzero(count > 0)
                own_odds = without_own(table) if own_odds is None else own_odds
                own = learn(
                    table, size[keep].astype(np.int64), _ragged(size, body, keep), count[keep], count[keep], total, own_odds
                )
                out = own if out is None else out + own
        if out is not None:
            yield chunks.sliced(out)

    return learned


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own in profiles(batch["text"]):
            row = [own.first.astype(np.int32).tobytes(), own.slot.astype(np.uint16).tobytes(), own.count.astype(np.uint32).tobytes()]
            yield pa.RecordBatch.from_pydict({"body": pa.array([row], pa.list_(pa.binary()))})


def _added(function):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for row in batch["body"].to_pylist():
                own = Profiles(*(np.frombuffer(x, kind).astype(np.int64) for x, kind in zip(row, (np.int32, np.uint16, np.uint32))))
                part = function(own).astype(np.int64)
                out = part if out is None else out + part
        if out is not None:
            yield chunks.sliced(out)

    return add


def _answer(mixer: Mixer):
    def answer(key: tuple, sent: pa.Table, known: pa.Table) -> pa.Table:
        """log2 probability by bits and counts of each token, to every chunk, in its order."""
        name, count, size, body = _opened(known["body"].to_pylist(), np.int64)
        bits = mixer.log2_of_bits(size.astype(np.int64), body)
        chunk, names = chunks.opened(sent, [np.uint64])
        at = np.searchsorted(name, names)
        count = count.astype(np.int32) if count.max(initial=0) < 1 << 31 else count
        return chunks.answers(key[0].as_py(), chunk, bits[at].astype(np.float32), count[at])

    return answer


def _with_ends(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names and bytes (with a stop byte) of all tokens, ends of texts included; tokens of each text."""
    n = np.diff(words.first) + 1
    ends = np.cumsum(n)
    inside = np.ones(int(ends[-1]), bool)
    inside[ends - 1] = False
    name, size = np.full(len(inside), name_of(END)), np.full(len(inside), len(END) + 1, np.int32)
    name[inside], size[inside] = words.name, words.end - words.start + 1
    return name, size, n


def _joined(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names and bytes of the tokens of all parts; first of each text."""
    names, sizes, counts = ([part[k] for part in parts] for k in range(3))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    first = np.concatenate([[0], np.cumsum(join(counts, np.int64))]).astype(np.int64)
    return join(names, np.uint64), join(sizes, np.int32), first


def _tokens(texts: pa.Array, limit: int = _TOGETHER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _joined([_with_ends(split(texts.slice(i, j - i), lower=True)) for i, j in slices(texts, limit=limit)])


def _pair_keys(name: np.ndarray, first: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of each token with the one before; before a text stands an end."""
    before = np.concatenate([name[-1:], name[:-1]])
    before[first[:-1]] = name_of(END)
    key = mix(mix(before ^ _PAIR) + name)
    return (chunks.bucket_of(key, buckets).astype(np.uint64) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))


def _send_pairs(buckets: int):
    def send(key: tuple, table: pa.Table, tokens: tuple | None = None) -> pa.Table:
        """Distinct pairs of a chunk, sorted, with their counts in training documents; ``tokens`` as of ``_tokens``, if at hand."""
        learns = ~np.array(_column(table, "held_out").to_pylist(), bool)
        name, _, first = _tokens(_column(table, "text")) if tokens is None else tokens
        pair = _pair_keys(name, first, buckets)
        order = np.argsort(pair, kind="stable")
        at = chunks.heads(pair[order])
        own = np.repeat(learns, np.diff(first))[order]
        count = np.add.reduceat(own.astype(np.int64), at).astype(np.uint32)
        pair = pair[order][at]
        bucket = (pair >> np.uint64(32)).astype(np.int64)
        at = chunks.heads(bucket)
        cut = [*at.tolist(), len(pair)]
        low = pair.astype(np.uint32)
        return _messages(key, bucket[at], cut, [[low[a:b].tobytes(), count[a:b].tobytes()] for a, b in zip(cut, cut[1:])])

    return send


def _count_pairs(key: tuple, table: pa.Table) -> pa.Table:
    """Training counts of the pairs of a bucket, to every chunk, in its order."""
    chunk, low, count = chunks.opened(table, [np.uint32, np.uint32])
    order = np.argsort(low, kind="stable")
    at = chunks.heads(low[order])
    total = np.add.reduceat(count[order].astype(np.int64), at)
    every = np.empty(len(low), np.float32)
    every[order] = np.repeat(total, np.diff(np.append(at, len(low))))
    return chunks.answers(key[0].as_py(), chunk, every)


def _replies(table: pa.Table, kind: int, kinds: list, wide: int = 1) -> list[np.ndarray]:
    """The columns of the answers of a kind, by bucket: in the order of the chunk's keys.

    A column of two types has ``wide`` numbers a key, of the first type in the buckets where these fit.
    """
    columns = ("bucket", "kind", "n", "body")
    rows = sorted((b, n, body) for b, k, n, body in zip(*(table[c].to_pylist() for c in columns)) if k == kind)

    def column(body: bytes, n: int, t) -> np.ndarray:
        if isinstance(t, tuple):
            short = len(body) == n * wide * np.dtype(t[0]).itemsize
            return np.frombuffer(body, t[0] if short else t[1]).astype(t[1])
        return np.frombuffer(body, t)

    return [np.concatenate([column(body[i], n, t) for _, n, body in rows]) for i, t in enumerate(kinds)]


def _tally(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each key stood in its text before, and stands in the whole text."""
    bits = [int(x.max(initial=0)).bit_length() for x in (doc, key)] + [len(key).bit_length()]
    if sum(bits) < 64:  # one number says it all, and sorts faster
        order = np.sort((doc.astype(np.int64) << (bits[1] + bits[2])) | (key.astype(np.int64) << bits[2]) | np.arange(len(key)))
        at, order = chunks.heads(order >> bits[2]), order & ((1 << bits[2]) - 1)
    else:
        order = np.lexsort((key, doc))
        at = chunks.heads(key[order], doc[order])
    size = np.diff(np.append(at, len(key)))
    before, total = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    before[order] = np.arange(len(key)) - np.repeat(at, size)
    total[order] = np.repeat(size, size)
    return before, total


def in_context(
    token: np.ndarray, pair: np.ndarray, first: np.ndarray, learns: np.ndarray, of_pair: np.ndarray, of_before: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of each token after its predecessor, in the text so far and after its
    predecessor in the text so far; which of them can speak at all; the gate.

    ``of_pair``, ``of_before``: training counts of the pair and of the token before.
    """
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(token)) - first[:-1][doc]
    before, total = _tally(token, doc)
    pair_before, pair_total = _tally(pair, doc)
    lead = place > 0
    context_before, context_total = np.zeros(len(token), np.int64), np.ones(len(token), np.int64)
    context_before[1:], context_total[1:] = before[:-1], total[:-1]
    context_before[~lead], context_total[~lead] = 0, 1
    own = learns[doc]
    seen = np.maximum(of_before - own * context_total, 0.0)
    counts = np.stack([np.maximum(of_pair - own * pair_total, 0.0), before, pair_before], 1)
    out_of = np.stack([seen, place, context_before], 1)
    p = np.minimum(counts / np.maximum(out_of, 1), 1.0)
    gate = np.searchsorted(_SEEN, seen, "right") * (len(_FAR) + 1) + np.searchsorted(_FAR, place, "right")
    return p, out_of > 0, gate


def along(
    logs: np.ndarray, speaks: np.ndarray, gate: np.ndarray, first: np.ndarray, p: np.ndarray | None = None
) -> np.ndarray:
    """Log probability of each token, weights updated along each text after every block.

    ``logs``: log probabilities, the first column speaks everywhere and is finite; ``p``: the probabilities of
    the other columns, if at hand. Tokens are put in the order of their blocks, so a block of all texts is one stretch.
    """
    n, kinds, gates = np.diff(first), speaks.shape[1], len(START)
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(n))  # the texts that go on stand first
    step = (np.arange(len(logs)) - np.repeat(first[:-1], n)) // BLOCK
    order = np.argsort(step.astype(np.uint16) if step.max(initial=0) < 1 << 16 else step, kind="stable")
    spot = (np.repeat(rank * gates, n) + gate)[order]
    cut = np.concatenate([[0], np.cumsum(np.bincount(step))]).astype(np.int64)
    going = np.searchsorted(np.sort(-n), -BLOCK * np.arange(len(cut) - 1), "left")
    can, every = np.empty((kinds, len(logs))), np.empty((kinds, len(logs)))
    can[:] = speaks.T[:, order]
    spelled = logs[order, 0]
    every[0] = np.exp(np.maximum(spelled, _LEAST))
    with np.errstate(divide="ignore"):
        every[1:] = (np.exp(logs[:, 1:]) if p is None else p).T[:, order]
    every[1:] *= can[1:]
    weights = np.tile(START.T, (1, len(n)))
    mixed = np.empty(len(logs))
    for a, b, texts in zip(cut, cut[1:], going):
        own, at = weights[:, : texts * gates], spot[a:b]
        share = np.exp(own - own.max(0)).take(at, 1)
        share *= can[:, a:b]
        share /= share.sum(0)
        part = share * every[:, a:b]
        whole = mixed[a:b] = part.sum(0)
        part /= whole
        part -= share
        for k in range(kinds):
            own[k] += RATE * np.bincount(at, part[k], own.shape[1])
    out = np.empty(len(logs))
    # below the least power of two, only the first column can say what is left
    out[order] = np.log(mixed) + np.where(every[1:].any(0), 0, np.minimum(spelled - _LEAST, 0))
    return out


def _score(mixer: Mixer, totals: np.ndarray, kinds: int, buckets: int):
    tokens = int(totals.sum())
    log_prior = np.log((totals + 1) / (tokens + len(totals)))

    def score(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        names, sizes, starts = _tokens(_column(table, "text"))
        learns = ~np.array(_column(table, "held_out").to_pylist(), bool)
        name, ids = np.unique(names, return_inverse=True)
        bits, count = _replies(replies, 0, [np.float32, (np.int32, np.int64)], totals.size)
        bits, count = bits.astype(float), count.reshape(len(name), -1)
        pair, pairs = np.unique(_pair_keys(names, starts, buckets), return_inverse=True)
        (of_pair,) = _replies(replies, 1, [np.float32])
        if len(bits) != len(name) or len(of_pair) != len(pair):
            raise ValueError("a chunk got another number of answers than it sent keys")
        whole = count.sum(1)
        base = np.log10((whole + 0.5) / (tokens + 0.5 * (kinds + 1)))
        known = np.ascontiguousarray(mixer.known(count, totals).T)
        log_known = np.log(np.maximum(known, 1e-30))
        log_known[:, whole == 0] = 0  # an unknown token tells nothing of the class
        end = int(np.searchsorted(name, name_of(END)))
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "score", "bits_per_byte")}
        i = 0
        while i < len(starts) - 1:
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + _AT_ONCE, "right")) - 1)
            first = starts[i : j + 1] - starts[i]
            own = slice(starts[i], starts[j])
            at, size = ids[own], sizes[own]
            belief = adapt(log_known.take(at, 1).T, first, log_prior)
            p = mixer.share * (belief.T * known.take(at, 1)).sum(0) if tokens else np.zeros(len(at))
            spelled = bits[at] + (np.log2(1 - mixer.share) if tokens else 0)
            log = np.logaddexp2(spelled, np.log2(np.maximum(p, 1e-300))) * np.log(2)
            if tokens:
                before = np.concatenate([[end], at[:-1]])
                before[first[:-1]] = end
                p, speaks, gate = in_context(at, pairs[own], first, learns[i:j], of_pair[pairs[own]].astype(float), whole[before])
                log = along(log[:, None], np.concatenate([np.ones((len(at), 1), bool), speaks], 1), gate, first, p)
            add = lambda x: np.add.reduceat(x, first[:-1])
            found = (np.diff(first), add((whole[at] > 0).astype(np.int64)), add(base[at]), add(log) / np.log(10), -add(log) / np.log(2) / add(size.astype(np.int64)))
            for k, x in zip(out, found):
                out[k].append(x)
            i = j
        done = {k: np.concatenate(x) if x else np.zeros(0) for k, x in out.items()}
        done["n_tokens"], done["n_known"] = done["n_tokens"].astype(np.int64), done["n_known"].astype(np.int64)
        return pa.table({"id": _column(table, "id"), "held_out": _column(table, "held_out"), **done})

    return score


def score_texts(docs: DataFrame, held_out=None) -> DataFrame:
    """One row for each row of ``docs``; learns from those where ``held_out`` (a condition) is false."""
    spark = docs.sparkSession
    run = Run(spark, "scoring")
    if held_out is None:
        held_out = part_of(F.col("doc_id").cast("long")) == HELD_OUT
    own = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out")
    )
    total = chunks.text_bytes(own)
    dealt = chunks.chunked(own, ["id", "text", "held_out"], total, CHUNK_BYTES)
    buckets = max(1, -(-total // BUCKET_BYTES))
    held = run.keep(own.filter("NOT held_out").select("text").mapInArrow(_profiled, "body array<binary>"), "profiles")
    logs = fit_classes(lambda function, size: chunks.summed(held.mapInArrow(_added(function), chunks.SLICED), size), CLASSES)
    run.drop("profiles")
    pair_buckets = max(1, -(-total // PAIR_BYTES))
    messages = dealt.groupBy("chunk").applyInArrow(_send(buckets, pair_buckets, logs), f"{chunks.MESSAGE}, kind int")
    every = run.keep(messages, "sent", by="kind")
    sent, asked = (every.filter(F.col("kind") == kind).drop("kind") for kind in (0, 1))
    pairs = run.keep(asked.groupBy("bucket").applyInArrow(_count_pairs, chunks.MESSAGE), "pairs")
    run.drop("sent/kind=1")
    vocabulary = run.keep(
        sent.select("bucket", "body").groupBy("bucket").applyInArrow(_count, "bucket long, known long, tokens array<long>, body array<binary>"),
        "vocabulary",
    )
    row = vocabulary.agg(F.sum("known"), *[F.sum(F.get("tokens", F.lit(k))) for k in range(logs.shape[1])]).first()
    kinds, *totals = (int(x or 0) for x in row)
    tokens, totals = sum(totals), np.array(totals, float)
    wide = -(-buckets // BUCKETS_A_TABLE)
    summed = vocabulary.select("bucket", "body").repartition(wide, "bucket").mapInArrow(_add_up, chunks.SLICED)
    table = chunks.summed(summed, ORDERS * (2 << BITS)).reshape(ORDERS, -1).astype(np.float32)
    learned = vocabulary.select("body").mapInArrow(_learn(table, tokens), chunks.SLICED)
    mixer = taught(table, chunks.summed(learned, sum(_PARTS)), tokens)
    names = sent.select("bucket", "chunk", "n", F.slice("body", 1, 1).alias("body"))
    answered = names.groupBy("bucket").cogroup(vocabulary.select("bucket", "body").groupBy("bucket")).applyInArrow(
        _answer(mixer), chunks.MESSAGE
    )
    answered = run.keep(answered, "answered")
    run.drop("sent", "vocabulary")
    told = answered.withColumn("kind", F.lit(0)).unionByName(pairs.withColumn("kind", F.lit(1)))
    out = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_score(mixer, totals, kinds, pair_buckets), _RESULT)
    return out.withColumn("train_tokens", F.lit(tokens).cast("long")).withColumnRenamed("id", "doc_id")


def op10_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )
