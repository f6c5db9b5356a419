"""Substring dedup by recompression: drop words that repeat an earlier document.

A word goes if a window of ``window`` words covers it whose words also stand in a row in a
document with a smaller id. Three passes over chunks of documents:

1. Every window's highest recompression symbol (see recompress.py) is its key. A chunk
   sends its keys; a bucket answers which stand in other chunks too.
2. Windows with a shared key are compared by all their words: a chunk sends each such
   window with its smallest id, a bucket answers the smallest id of all chunks.
3. Words under windows whose smallest id is below the document's own are left out.

Equal windows have equal keys, so pass 1 loses none, and what it lets through by chance
falls in pass 2. Windows are told apart by 64 bits of their words and 60 of their key.

Defined results: a null or empty text has no words and stays as empty text; documents with
fewer words than a window keep all; rows of one id never remove from each other; a null id
neither removes nor loses words; an empty table gives an empty table. Other columns of the
input are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveplan.llm import chunks
from waveplan.llm.recompress import anchors, stretch_names
from waveplan.llm.store import Run, read
from waveplan.llm.words import mix, slices, split

WINDOW = 13
ROUNDS = 2
_NONE = np.iinfo(np.int64).max
_RESULT = "id long, n_words long, n_removed long, kept_text string"


def _keys(texts: pa.Array, window: int):
    """Words, window starts, keys and full names of the windows, slice by slice."""
    for i, j in slices(texts):
        words = split(texts.slice(i, j - i))
        starts, key = anchors(words.name, words.first, window, ROUNDS)
        name = stretch_names(words.name, window)(starts, starts + window - 1)
        yield i, words, starts, mix(key), name


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _ids(table: pa.Table) -> np.ndarray:
    return _column(table, "id").fill_null(_NONE).to_numpy()


def _send_keys(window: int, buckets: int):
    def send(key: tuple, table: pa.Table) -> pa.Table:
        """The chunk's keys; ``flag`` tells that two of its own documents share it."""
        ids, parts = _ids(table), []
        for i, words, starts, keys, _ in _keys(_column(table, "text"), window):
            doc = ids[i + words.doc[starts]]
            real = doc != _NONE
            keys, doc = keys[real], doc[real]
            order = np.argsort(keys, kind="stable")
            keys, doc = keys[order], doc[order]
            at = chunks.heads(keys)
            if len(at):
                parts.append((keys[at], np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)))
        keys, low, high = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.uint64)] * 3
        order = np.argsort(keys, kind="stable")
        keys, low, high = keys[order], low[order], high[order]
        at = chunks.heads(keys)
        if len(at):
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
        return chunks.messages(key[0].as_py(), keys[at], buckets, (low != high).astype(np.uint8))

    return send


def _shared_keys(key: tuple, table: pa.Table) -> pa.Table:
    """Tell every chunk which of its keys stand in two documents or more."""
    chunk, keys, flag = chunks.opened(table, [np.uint64, np.uint8])
    order = np.argsort(keys, kind="stable")
    at = chunks.heads(keys[order])
    count = np.diff(np.append(at, len(keys)))
    shared = np.zeros(len(keys), bool)
    if len(at):
        shared[order] = np.repeat((count > 1) | (np.maximum.reduceat(flag[order], at) > 0), count)
    return chunks.answers(key[0].as_py(), chunk[shared], keys[shared])


def _send_windows(window: int, buckets: int):
    def send(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        """Windows under shared keys: names and the smallest id in the chunk."""
        ids = _ids(table)
        known = np.sort(chunks.opened(replies, [np.uint64])[1])
        parts = []
        for i, words, starts, keys, names in _keys(_column(table, "text"), window):
            doc = ids[i + words.doc[starts]]
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            wanted = (doc != _NONE) & (known[at] == keys) if len(known) else np.zeros(len(keys), bool)
            parts.append((names[wanted], keys[wanted], doc[wanted]))
        names, keys, doc = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.uint64)] * 3
        order = np.lexsort((keys, names))
        names, keys, doc = names[order], keys[order], doc[order].astype(np.int64)
        at = chunks.heads(names, keys)
        low, high = (f.reduceat(doc, at) if len(at) else doc for f in (np.minimum, np.maximum))
        return chunks.messages(
            key[0].as_py(), names[at], buckets, keys[at], low, (low != high).astype(np.uint8)
        )

    return send


def _first_ids(key: tuple, table: pa.Table) -> pa.Table:
    """Tell every chunk the smallest id of each window that it doesn't hold alone."""
    chunk, names, keys, low, flag = chunks.opened(table, [np.uint64, np.uint64, np.int64, np.uint8])
    order = np.lexsort((keys, names))
    at = chunks.heads(names[order], keys[order])
    count = np.diff(np.append(at, len(names)))
    least = np.zeros(len(names), np.int64)
    if len(at):
        least[order] = np.repeat(np.minimum.reduceat(low[order], at), count)
    tell = (least < low) | (flag > 0)
    return chunks.answers(key[0].as_py(), chunk[tell], names[tell], least[tell])


def _cover(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _clean(window: int):
    def clean(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, texts = _ids(table), _column(table, "text")
        _, names, least = chunks.opened(replies, [np.uint64, np.int64])
        order = np.argsort(names, kind="stable")
        names, least = names[order], least[order]
        n_words, n_removed, kept = [], [], []
        for i, j in slices(texts):
            words = split(texts.slice(i, j - i))
            n = len(words.name)
            starts = np.arange(n)
            starts = starts[starts + window <= np.repeat(words.first[1:], np.diff(words.first))]
            gone = np.zeros(n, bool)
            if len(names) and len(starts):
                name = stretch_names(words.name, window)(starts, starts + window - 1)
                at = np.minimum(np.searchsorted(names, name), len(names) - 1)
                doc = ids[i + words.doc[starts]]
                hit = (names[at] == name) & (least[at] < doc) & (doc != _NONE)
                gone = _cover(starts[hit], window, n)
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[words.first[1:]] - total[words.first[:-1]]
            n_words.append(np.diff(words.first))
            n_removed.append(removed)
            for d in range(j - i):
                own = words.data[words.offsets[d] : words.offsets[d + 1]].tobytes().split()
                if removed[d]:
                    stays = ~gone[words.first[d] : words.first[d + 1]]
                    own = [w for w, s in zip(own, stays.tolist()) if s]
                kept.append(b" ".join(own))
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table(
            {
                "id": _column(table, "id"),
                "n_words": join(n_words),
                "n_removed": join(n_removed),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    return clean


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_removed and kept_text."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = chunks.text_bytes(own)
    dealt = chunks.chunked(own, ["id", "text"], total)
    buckets = max(1, total // (20 * chunks.BUCKET_KEYS))
    run = Run(spark, "substring")
    sent = dealt.groupBy("chunk").applyInArrow(_send_keys(window, buckets), chunks.MESSAGE)
    shared = run.keep(sent.groupBy("bucket").applyInArrow(_shared_keys, chunks.MESSAGE), "shared")
    sent = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(
        _send_windows(window, buckets), chunks.MESSAGE
    )
    least = run.keep(sent.groupBy("bucket").applyInArrow(_first_ids, chunks.MESSAGE), "least")
    run.drop("shared")
    out = dealt.groupBy("chunk").cogroup(least.groupBy("chunk")).applyInArrow(_clean(window), _RESULT)
    return out.withColumnRenamed("id", id_col)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), one AS (
  SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS phrase FROM one WHERE i + 12 <= len(words)
), first AS (
  SELECT phrase, min(doc_id) AS least FROM win GROUP BY phrase
), bad AS (
  SELECT DISTINCT doc_id, i + j AS i
  FROM win JOIN first USING (phrase), (SELECT unnest(range(13)) AS j)
  WHERE least < doc_id
), gone AS (
  SELECT doc_id, count(*) AS n, list(i) AS spots FROM bad GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN words
    ELSE list_filter(words, lambda x, i: NOT list_contains(spots, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
