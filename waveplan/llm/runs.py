"""Periodic runs of words: suffix trees, Lyndon roots and extension in both directions.

A run is a stretch of words with smallest period q (words q apart are the same) that no
neighbouring word extends, here of at least ``least`` words and ``times`` periods. Take the
suffixes of a text in the order of some order of its words, and in that of the opposite one.
From each word to the next smaller suffix reaches the longest Lyndon word that starts there, and
each run holds a period that is such a word in one of the two orders. So there are at most two
candidates a word: (place, period). Each is extended to the right by the longest common
extension of its two ends, and to the left by that of the reversed text; both come from suffix
trees built online, with constant-time lowest common ancestors (see ``suffix``).

Trees are built only where a run can be. All words of a run of ``least`` words or more lie in
windows of ``least - least // times`` words that stand again q words on, inside the run. So
windows are named by hashes, words that no repeated window covers are left out, and so is a
stretch of covered words shorter than ``least`` or than ``times`` times the least distance at
which one of its windows repeats. Nothing else can hold a run, and a run of such a stretch
cannot be extended beyond it. Equal hashes of different windows cost time only, as trees compare words.

A text is worked on alone, in the task that reads it: nothing is shuffled, and memory follows
the longest text (about a kilobyte for each of its covered words).

Defined results: a null text has no words; rows that repeat an id are texts of their own; an
empty table gives an empty table; a null id is kept (and not altered, see ``op13_runs``).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveplan.llm.store import read, small_batches
from waveplan.llm.suffix import Extensions
from waveplan.llm.words import mix, slices, split

LEAST = 24
TIMES = 3
_FOUND = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: Which word stands at each place of a text of n words, by id; None leaves the text as it is.
Altered = Callable[[int | None, int], np.ndarray | None]


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix the place of the next smaller one; the empty suffix is the smallest."""
    ranks = rank.tolist()
    n = len(ranks) - 1
    out = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        j, own = i + 1, ranks[i]
        while ranks[j] > own:
            j = out[j]
        out[i] = j
    return np.array(out[:n], np.int64)


def runs(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, sorted."""
    n = len(words)
    if n < max(least, 2):
        return []
    number = {}
    symbols = [number.setdefault(w, len(number)) for w in words]
    ahead, back = Extensions(symbols), Extensions(symbols[::-1])
    found = set()
    for rank in (ahead.rank, ahead.falling_rank()):
        root = np.arange(n)
        after = next_smaller(rank)
        root, after = root[after < n], after[after < n]
        period = after - root
        right = ahead.common(root, after)
        left = back.common(n - root, n - after)
        length = left + period + right
        good = length >= np.maximum(least, times * period)
        found.update(zip((root - left)[good].tolist(), length[good].tolist(), period[good].tolist()))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(names: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Word ranges outside of which no run can be; ``names`` of all words, ``doc`` of each."""
    window = least - least // times
    gram, width = names, 1
    while width < window:
        # the two halves may overlap
        step = min(width, window - width)
        gram = mix(gram[: len(gram) - step] * _ODD + gram[step:])
        width += step
    if not len(gram):
        return []
    place = np.flatnonzero(doc[: len(gram)] == doc[window - 1 :])
    gram = mix(gram[place] ^ mix(doc[place].astype(np.uint64)))
    order = np.argsort(gram, kind="stable")
    gram, place = gram[order], place[order]
    again = np.flatnonzero(gram[1:] == gram[:-1])
    if not len(again):
        return []
    far = np.full(len(names), len(names))
    far[place[again]] = place[again + 1] - place[again]
    repeated = np.zeros(len(names), bool)
    repeated[place[again]] = repeated[place[again + 1]] = True
    edge = np.zeros(len(names) + 1, np.int64)
    starts = np.flatnonzero(repeated)
    edge[starts] += 1
    np.add.at(edge, starts + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    begin = covered.copy()
    begin[1:] &= ~covered[:-1] | (doc[1:] != doc[:-1])
    stop = covered.copy()
    stop[:-1] &= ~covered[1:] | (doc[1:] != doc[:-1])
    out = []
    for s, e in zip(np.flatnonzero(begin).tolist(), (np.flatnonzero(stop) + 1).tolist()):
        if e - s >= max(least, times * int(far[s:e].min())):
            out.append((s, e))
    return out


def _search(least: int, times: int, altered: Altered | None):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch["id"].to_pylist(), batch["text"]
            for i, j in slices(texts):
                part = split(texts.slice(i, j - i))
                source = np.arange(len(part.name))
                first = part.first.tolist()
                for d in range(j - i):
                    own = altered(ids[i + d], first[d + 1] - first[d]) if altered else None
                    if own is not None:
                        source[first[d] : first[d + 1]] = first[d] + own
                found = [[] for _ in range(j - i)]
                doc = part.doc
                for s, e in stretches(part.name[source], doc, least, times):
                    own, d = [part.word(k) for k in source[s:e].tolist()], int(doc[s])
                    found[d] += [(a + s - first[d], size, period) for a, size, period in runs(own, least, times)]
                kept = []
                for d in range(j - i):
                    words = part.data[part.offsets[d] : part.offsets[d + 1]].tobytes().split()
                    own = source[first[d] : first[d + 1]] - first[d]
                    stays = np.ones(len(own), bool)
                    for start, size, period in found[d]:
                        stays[start + period : start + size] = False
                    if found[d] or (altered and (own != np.arange(len(own))).any()):
                        words = [words[k] for k in own[stays].tolist()]
                    kept.append(b" ".join(words))
                found = [[dict(zip(("start", "length", "period"), r)) for r in sorted(f, key=lambda r: (r[0], r[2]))] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(i, j - i), pa.array(np.diff(part.first), pa.int64()), pa.array(found, _RUN), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["id", "n_words", "runs", "collapsed"],
                )

    return search


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, altered: Altered | None = None
) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, all runs by start, and the text without
    what repeats: words that a run contains after its first period are dropped."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_search(least, times, altered), _FOUND).withColumnRenamed("id", id_col)


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """One text in ten repeats a part of itself from some word on; both follow from its id."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return np.concatenate([np.arange(a), a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))])


def op13_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(read(spark, sf_dir, "documents"), altered=looped)
    text = lambda *names: F.concat_ws(",", *[n.cast("string") for n in names])
    lines = F.transform("runs", lambda r: F.concat(text(r["start"], r["length"], r["period"]), F.lit("\n")))
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    # runs come by start and period, so the first of equal ones stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(more(b, a), b).otherwise(a))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[name].alias(name) for name in ("start", "length", "period")],
        F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
