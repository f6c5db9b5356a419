"""Quality rules: hashed n-gram logistic regression on labelled rows, and counted rules.

Features are word 1- and 2-grams and byte 3- and 4-grams hashed to one table of weights; a
text's score is a bias plus the mean weight of each kind of gram. Training takes a bounded
sample of labelled rows (``SAMPLE_ROWS`` documents of at most ``SAMPLE_BYTES`` bytes each,
picked by a hash of the id); two thirds fit the weights, one third fits the calibration that
turns scores to probabilities. Every whole text is scored in Arrow batches. A text is kept
if the counted rules pass and its probability of being good is at least ``THRESHOLD``.

Counts: n_words; word_chars, code points in words; n_symbols, characters of #*$%&|<>;
n_dup_lines, lines with a word that equal an earlier line; n_repeat_words, words in windows
of three words that stand twice or more in the text.

Defined results: a null or empty text has all counts 0 and fails the rules; several labels
of one document count as their mean, labels other than 0 and 1 and of unknown documents are
not used; with labels of one class only, or none, every text has probability 1; rows of one
id are judged each for itself, a null id like any other; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveplan.llm.store import read, small_batches
from waveplan.llm.words import IS_WORD, Words, mix, slices, split

BITS = 18
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 1 << 16
STEPS = 80
THRESHOLD = 0.5
LEAST_WORDS = 50
SCALE = 20.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SALTS = tuple(np.uint64(x) for x in (0x9AE16A3B2F90404F, 0xC3A5C85C97CB3127))
_BYTE_SALTS = (np.uint32(2_654_435_761), np.uint32(2_246_822_519))
_RESULT = (
    "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, p_good double"
)


def per_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of the values between neighbouring edges."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[edges[1:]] - total[edges[:-1]]


def grams(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of gram: the slot of every gram, and where each text's grams begin."""
    shift = np.uint64(64 - BITS)
    name, first = words.name, words.first
    yield ((name * _SALTS[0]) >> shift).astype(np.int32), first
    inner = np.ones(max(len(name) - 1, 0), bool)
    inner[first[(first > 0) & (first < len(name))] - 1] = False
    pair = (mix(name[:-1] * _SALTS[1] + name[1:]) >> shift).astype(np.int32)[inner]
    yield pair, np.concatenate([[0], np.cumsum(np.maximum(np.diff(first) - 1, 0))])
    data = words.data.astype(np.uint32)
    for width, salt in zip((3, 4), _BYTE_SALTS):
        n = max(len(data) - width + 1, 0)
        code = np.zeros(n, np.uint32)
        for k in range(width):
            code |= data[k : k + n] << np.uint32(8 * k)
        slot = ((code * salt) >> np.uint32(32 - BITS)).astype(np.int32)
        whole = np.ones(n, bool)
        for k in range(1, width):  # grams that cross a text's end
            at = words.offsets[1:-1] - k
            whole[at[(at >= 0) & (at < n)]] = False
        slot = slot[whole]
        # texts shorter than a gram lose less than width - 1 places
        lost = np.concatenate([[0], np.cumsum(~whole)])
        edges = np.minimum(words.offsets, n)
        yield slot, edges - lost[edges]


def counts(texts: pa.Array, words: Words) -> dict[str, np.ndarray]:
    """The counted rules' numbers of every text."""
    data, offsets, first, name = words.data, words.offsets, words.first, words.name
    inside = IS_WORD[data]
    out = {
        "n_words": np.diff(first),
        "word_chars": per_text(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_text(_SYMBOL[data], offsets),
    }
    dup = np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        lines = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
        if len(lines) > 1:
            full = [x for x in lines if x.strip()]
            dup[i] = len(full) - len(set(full))
    out["n_dup_lines"] = dup
    doc = words.doc
    n = max(len(name) - 2, 0)
    at = np.flatnonzero(doc[:n] == doc[2:]) if n else np.zeros(0, int)
    triple = mix(mix(name[at] * _SALTS[0] + name[at + 1]) * _SALTS[1] + name[at + 2]) if n else name[:0]
    order = np.lexsort((triple, doc[at])) if len(at) else at
    same = (triple[order][1:] == triple[order][:-1]) & (doc[at][order][1:] == doc[at][order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(name), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    out["n_repeat_words"] = per_text(covered, first)
    return out


@dataclass
class Model:
    """Weights of the slots, bias, and the calibration p = sigmoid(slope * score + shift)."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, words: Words) -> np.ndarray:
        total = np.full(len(words.first) - 1, self.bias)
        for slot, edges in grams(words):
            n = np.maximum(np.diff(edges), 1)
            total += SCALE * per_text(self.weights[slot].astype(float), edges) / n
        return total

    def probabilities(self, words: Words) -> np.ndarray:
        return _sigmoid(self.slope * self.scores(words) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's scaling: Newton steps on smoothed targets, with a little shrinkage."""
    good, bad = y.sum(), len(y) - y.sum()
    aim = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * score + b)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - aim) * score).sum() + 1e-3 * (a - 1), (p - aim).sum()])
        h = np.array([[(w * score * score).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def train(texts: list[str], labels: np.ndarray, seed: int = 4) -> Model | None:
    """Fit on labelled texts; None if they hold one class only."""
    y = np.asarray(labels, float)
    if len(y) < 6 or y.min() == y.max():
        return None
    rows, slots, values = [], [], []
    column = pa.array(texts, pa.string())
    for i, j in slices(column):
        for slot, edges in grams(split(column.slice(i, j - i))):
            n = np.diff(edges)
            code = np.repeat(np.arange(j - i), n).astype(np.int64) << BITS | slot
            code, times = np.unique(code, return_counts=True)
            row = code >> BITS
            rows.append((row + i).astype(np.int32))
            slots.append((code & ((1 << BITS) - 1)).astype(np.int32))
            values.append((SCALE * times / n[row]).astype(np.float32))
    row, slot, value = np.concatenate(rows), np.concatenate(slots), np.concatenate(values)
    held = np.arange(len(y)) % 3 == 2
    if min(y[held].sum(), (~held & (y > 0)).sum(), (held & (y == 0)).sum(), (~held & (y == 0)).sum()) == 0:
        held[:] = False
    fit = ~held[row]
    used, place = np.unique(slot[fit], return_inverse=True)
    fit_row, fit_value = row[fit], value[fit]
    w, bias = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    inside = ~held
    for step in range(1, STEPS + 1):
        z = np.bincount(fit_row, w[place] * fit_value, len(y)) + bias
        error = np.where(inside, _sigmoid(z) - y, 0) / inside.sum()
        g = np.bincount(place, error[fit_row] * fit_value, len(used)) + 1e-5 * w
        gb = error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 / (1 - 0.9**step)
        w -= rate * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        bias -= rate * mb / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    z = np.bincount(row, weights[slot] * value, len(y)) + bias
    check = held if held.any() else np.ones(len(y), bool)
    return Model(weights, float(bias), *calibrate(z[check], y[check]))


def sample(docs: DataFrame, labels: DataFrame, rows: int, size: int) -> tuple[list[str], np.ndarray]:
    """At most ``rows`` labelled texts of at most ``size`` bytes, picked by a hash of the id."""
    marks = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("good"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.filter(F.octet_length("text").between(1, size))
    order = F.xxhash64("doc_id", F.lit(4))
    # the ids first, so that only the picked texts are sorted and sent
    ids = own.select("doc_id").distinct().join(marks, "doc_id").orderBy(order, "doc_id").limit(rows)
    picked = own.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("good").alias("good"))
    found = picked.orderBy(order, "doc_id").collect()
    return [r["text"] for r in found], np.array([r["good"] >= 0.5 for r in found], float)


def _judge(model: Model | None):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch["text"]):
                part = batch.slice(i, j - i)
                words = split(part["text"])
                out = {"id": part["id"], **counts(part["text"], words)}
                out["p_good"] = model.probabilities(words) if model else np.ones(j - i)
                yield pa.RecordBatch.from_pydict({k: pa.array(x) if isinstance(x, np.ndarray) else x for k, x in out.items()})

    return judge


def judge_quality(
    docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, threshold: float = THRESHOLD
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the counts, p_good, base_failed and kept."""
    small_batches(docs.sparkSession)
    model = train(*sample(docs, labels, rows, size))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    out = own.mapInArrow(_judge(model), _RESULT).withColumnRenamed("id", "doc_id")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def _keep(model: Model | None, threshold: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch["text"].cast(pa.string())
            for i, j in slices(text):
                part = text.slice(i, j - i)
                words = split(part)
                own = counts(part, words)
                good = (own["n_words"] >= LEAST_WORDS) & (100 * own["n_repeat_words"] <= 50 * own["n_words"])
                if model:
                    good &= model.probabilities(words) >= threshold
                yield batch.slice(i, j - i).filter(pa.array(good))

    return keep


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that judge_quality() keeps."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_keep(train(*sample(docs, labels, SAMPLE_ROWS, SAMPLE_BYTES)), threshold), docs.schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    out = judge_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )
