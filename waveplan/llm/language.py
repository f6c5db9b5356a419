"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows; each filter's
maximum over the window feeds a softmax. The input is one byte out of 256 at each place, so a
filter is a table with a row for each byte and tap, and a convolution is a sum of looked-up
rows. Training (numpy, Adam) takes windows of a bounded sample of labelled texts:
``SAMPLE_ROWS`` rows picked by a hash of the id, ``SAMPLE_WINDOWS`` windows of each at
places given by a hash. Prediction goes over every window of every whole text in Arrow
batches and averages the log-probabilities of a text's windows, weighed by their bytes.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every
text if there is no language to learn; with one language that language is the answer; ties
go to the smaller language by code point; rows of one id are predicted each for itself;
bytes, not ids, sources or labels, decide; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveplan.llm.store import part_of, read, small_batches
from waveplan.llm.words import raw, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE_ROWS = 3000
SAMPLE_WINDOWS = 2
SAMPLE_BYTES = 1 << 16
EPOCHS = 8
BATCH = 128
UNKNOWN = "und"
_AT_ONCE = 64
_RESULT = "id long, held_out boolean, lang_pred string, score double"


@dataclass
class Network:
    """taps[j]: rows for the byte at offset j, one column a filter whose width exceeds j.

    Filters are sorted from the widest to the narrowest, so each tap has the first columns.
    """

    languages: list[str]
    taps: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def features(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maximum of each filter in each window (rows of WINDOW bytes), and its place."""
        n, length = windows.shape
        places = length - len(self.taps) + 1
        total = np.empty((n, places, len(self.bias)), np.float32)
        np.take(self.taps[0], windows[:, :places], axis=0, out=total)
        for j, tap in enumerate(self.taps[1:], 1):
            total[:, :, : tap.shape[1]] += tap[windows[:, j : j + places]]
        where = total.argmax(1) if self._places else None
        best = np.take_along_axis(total, where[:, None, :], 1)[:, 0] if self._places else total.max(1)
        return np.maximum(best + self.bias, 0), where

    _places = False

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.features(windows)[0] @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, short ones filled with zero bytes; text and bytes of each."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), count)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    length = np.minimum(size[text] - start, WINDOW)
    place = np.arange(WINDOW)
    at = np.minimum((offsets[text] + start)[:, None] + place, max(len(data) - 1, 0))
    windows = np.where(place < length[:, None], data[at], 0) if len(data) else np.zeros((0, WINDOW), np.uint8)
    return windows.astype(np.uint8), text, length


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 3) -> Network:
    """Fit the network; only a filter's best place in a window gets its gradient."""
    random = np.random.default_rng(seed)
    widths = [w for w in sorted(WIDTHS, reverse=True) for _ in range(FILTERS)]
    n = len(widths)
    taps = [random.normal(0, 0.3, (256, sum(w > j for w in widths))).astype(np.float32) for j in range(max(widths))]
    net = Network(
        languages, taps, np.zeros(n, np.float32),
        random.normal(0, 0.2, (n, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
    )
    net._places = True
    params = [*net.taps, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(windows))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            x, y = windows[own], labels[own]
            hidden, where = net.features(x)
            z = hidden @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ net.out.T) * (hidden > 0)
            grads = [np.zeros_like(t) for t in net.taps]
            for j, g in enumerate(grads):
                k = g.shape[1]
                byte = x[np.arange(len(x))[:, None], where[:, :k] + j]
                np.add.at(g, (byte, np.arange(k)[None, :]), back[:, :k])
            grads += [back.sum(0), hidden.T @ p, p.sum(0)]
            step += 1
            for q, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= (0.01 / (1 - 0.9**step) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    net._places = False
    return net


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Network | None:
    """Train on ``docs`` (doc_id, text, lang); None if no text has a language."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    own = own.filter("lang IS NOT NULL").filter(F.octet_length("text").between(1, size))
    order = F.xxhash64("doc_id", F.lit(3))
    # ids first, so that only the picked texts are sorted and sent
    ids = own.select("doc_id").distinct().orderBy(order, "doc_id").limit(rows)
    picked = own.join(F.broadcast(ids), own["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    # rows that share an id, or have none, count one by one
    picked = picked.distinct().orderBy(order, "doc_id", F.xxhash64("text"), "lang", "text").limit(rows)
    found = sorted((r["lang"], r["doc_id"] or 0, r["text"]) for r in picked.collect())
    languages = sorted({r[0] for r in found})
    if not languages:
        return None
    windows, labels = [], []
    for lang, doc_id, text in found:
        data, offsets = raw(pa.array([text]))
        own_windows, _, length = cut(data, offsets)
        spread = [zlib.crc32(f"{doc_id}:{k}".encode()) for k in range(len(own_windows))]
        for k in sorted(range(len(own_windows)), key=lambda k: (-length[k] // 64, spread[k]))[:SAMPLE_WINDOWS]:
            windows.append(own_windows[k])
            labels.append(languages.index(lang))
    return train(np.stack(windows), np.array(labels), languages)


def _predict(net: Network | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch["text"]):
                part = batch.slice(i, j - i)
                n = j - i
                langs, score = np.full(n, UNKNOWN, object), np.zeros(n)
                letter = np.array([bool(x) for x in part["letter"].to_pylist()], bool)
                if net:
                    total, weight = np.zeros((n, len(net.languages))), np.zeros(n)
                    windows, text, length = cut(*raw(part["text"]))
                    for a in range(0, len(text), _AT_ONCE):
                        own = slice(a, a + _AT_ONCE)
                        np.add.at(total, text[own], net.log_probabilities(windows[own]) * length[own, None])
                        np.add.at(weight, text[own], length[own])
                    mean = total / np.maximum(weight, 1)[:, None]
                    p = np.exp(mean - mean.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    langs[letter] = np.array(net.languages, object)[p.argmax(1)][letter]
                    score[letter] = p.max(1)[letter]
                yield pa.RecordBatch.from_pydict(
                    {"id": part["id"], "held_out": part["held_out"], "lang_pred": pa.array(langs, pa.string()), "score": pa.array(score)}
                )

    return predict


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    own = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        (part_of(F.col("doc_id").cast("long")) == 0).alias("held_out"),
        text.alias("text"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"),
    )
    return own.mapInArrow(_predict(net), _RESULT).withColumnRenamed("id", "doc_id")


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = learn(docs.filter(part_of(F.col("doc_id").cast("long")) != 0))
    return identify(docs, net)
