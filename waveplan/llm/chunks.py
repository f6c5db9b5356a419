"""Chunks of documents that exchange keyed numbers with each other.

Texts are dealt by a hash of their id into chunks of bounded size. A chunk sends each key
it holds once, to the bucket of that key; a bucket answers the chunks. So a key that stands
in a third of all documents arrives once from each chunk, not once from each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveplan.llm.store import cleaned

#: Bytes of text in a chunk, on average.
CHUNK_BYTES = 8 << 20
#: Keys in a bucket, on average.
BUCKET_KEYS = 1 << 19

MESSAGE = "bucket long, chunk long, n long, body array<binary>"


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    row = docs.agg(F.sum(F.octet_length(F.col(text).cast("string"))).alias("n")).first()
    return int(row["n"] or 0)


def chunked(docs: DataFrame, columns: list[str], total: int, size: int = CHUNK_BYTES) -> DataFrame:
    """The named columns and the chunk of each row; rows of one id share a chunk."""
    count = max(1, -(-total // size))
    chunk = F.coalesce(F.pmod(F.xxhash64(F.col(columns[0])), F.lit(count)), F.lit(0))
    return docs.select(*columns, chunk.alias("chunk"))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """floor(key * buckets / 2 ** 64): sorted keys have sorted buckets. At most 2 ** 32 buckets."""
    low, wide = np.uint64(32), np.uint64(buckets)
    carry = ((keys & np.uint64(0xFFFFFFFF)) * wide) >> low
    return (((keys >> low) * wide + carry) >> low).astype(np.int64)


def messages(chunk: int, keys: np.ndarray, buckets: int, *columns: np.ndarray) -> pa.Table:
    """One row for each bucket with a key: the keys (sorted, spread over 64 bits) and their columns."""
    bucket = bucket_of(keys, buckets)
    at = heads(bucket)
    cut = [*at.tolist(), len(keys)]
    body = [[x[a:b].tobytes() for x in (keys, *columns)] for a, b in zip(cut, cut[1:])]
    return pa.table(
        {
            "bucket": pa.array(bucket[at], pa.int64()),
            "chunk": pa.array([chunk] * len(at), pa.int64()),
            "n": pa.array(np.diff(cut), pa.int64()),
            "body": pa.array(body, pa.list_(pa.binary())),
        }
    )


def opened(table: pa.Table, kinds: list) -> list[np.ndarray]:
    """The chunk of every number received, and the columns of the bodies, joined."""
    chunk = np.repeat(table["chunk"].to_numpy(), table["n"].to_numpy())
    bodies = table["body"].to_pylist()
    return [chunk] + [
        np.concatenate([np.frombuffer(b[i], kind) for b in bodies]) if bodies else np.zeros(0, kind)
        for i, kind in enumerate(kinds)
    ]


def answers(bucket: int, chunk: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """One row for each chunk that gets an answer from a bucket."""
    order = np.argsort(chunk, kind="stable")
    chunk = chunk[order]
    columns = [x[order] for x in columns]
    cut = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else np.zeros(0, int)
    cut = [*cut.tolist(), len(chunk)]
    return pa.table(
        {
            "bucket": pa.array([bucket] * (len(cut) - 1), pa.int64()),
            "chunk": pa.array([int(chunk[a]) for a in cut[:-1]], pa.int64()),
            "n": pa.array([b - a for a, b in zip(cut, cut[1:])], pa.int64()),
            "body": pa.array([[x[a:b].tobytes() for x in columns] for a, b in zip(cut, cut[1:])], pa.list_(pa.binary())),
        }
    )


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted columns."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(out)


SLICED = "slice long, sums binary"
_SLICES = 16


def sliced(numbers: np.ndarray) -> pa.RecordBatch:
    """Counts in an array of fixed size, cut up to be added to those of other tasks; sums are exact."""
    parts = np.array_split(numbers.astype(np.int64).ravel(), _SLICES)
    return pa.RecordBatch.from_pydict({"slice": list(range(_SLICES)), "sums": [p.tobytes() for p in parts]})


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the slices that came to this task, one sum held for each."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch["slice"].to_pylist(), batch["sums"].to_pylist()):
            own = np.frombuffer(part, np.int64)
            sums[k] = sums[k] + own if k in sums else own
    if sums:
        yield pa.RecordBatch.from_pydict({"slice": list(sums), "sums": [x.tobytes() for x in sums.values()]})


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' arrays of ``size`` numbers (a fixed number, whatever the input)."""
    with cleaned(parts.sparkSession):
        rows = parts.repartition(_SLICES, "slice").mapInArrow(_total, SLICED).collect()
    sums = {r["slice"]: np.frombuffer(r["sums"], np.int64) for r in rows}
    return np.concatenate([sums[k] for k in range(_SLICES)]) if sums else np.zeros(size, np.int64)
