"""Packing into optimal length buckets.

Documents are cut into pieces of at most ``sequence`` tokens. A histogram of all pieces'
lengths (at most ``sequence`` entries, whatever the input) goes to the driver, where dynamic
programming picks the bucket boundaries that make padding least. Inside a bucket, pieces are
dealt by a hash to cells of about ``cell`` pieces, and each cell fills batches up to the
token budget, padding included. A cell can leave one batch partly filled; more data means
more cells, not larger ones.

A token is a word; the last piece of a document also has one end token, so an empty or null
text is one piece of one token. Defined results: rows of one id are documents of their own
and may share batches; a null id is kept; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveplan.llm.store import Run, read

SEQUENCE = 2048
BUCKETS = 16
BUDGET = 65_536
CELL = 8192


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least padding in total.

    ``lengths``: distinct, rising. Padding of a bucket over lengths i..j is
    lengths[j] * (pieces in i..j) - (tokens in i..j).
    """
    n = len(lengths)
    if n == 0:
        return []
    lengths = lengths.astype(float)
    pieces = np.concatenate([[0.0], np.cumsum(counts, dtype=float)])
    tokens = np.concatenate([[0.0], np.cumsum(counts * lengths)])
    # best[j]: least padding of the first j lengths
    best = np.concatenate([[0.0], lengths * pieces[1:] - tokens[1:]])
    choice = [np.zeros(n + 1, int)]
    for _ in range(1, min(buckets, n)):
        better, cut = best.copy(), np.zeros(n + 1, int)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (pieces[j] - pieces[:j]) - (tokens[j] - tokens[:j])
            i = int(np.argmin(cost))
            better[j], cut[j] = cost[i], i
        best = better
        choice.append(cut)
    ends, j = [], n
    for cut in reversed(choice):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = int(cut[j])
    return sorted(set(ends))


def padding(lengths: np.ndarray, counts: np.ndarray, ends: list[int]) -> int:
    at = np.asarray(ends)[np.searchsorted(ends, lengths)]
    return int(((at - lengths) * counts).sum())


def _pick(by: dict[int, int], of: Column) -> Column:
    """A value for each bucket end; at most BUCKETS of them."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in by.items() for x in pair]), of)


def pack(
    docs: DataFrame, sequence: int = SEQUENCE, buckets: int = BUCKETS, budget: int = BUDGET, cell: int = CELL
) -> DataFrame:
    """One row for each piece: where it stands in its document, its bucket, batch and place."""
    run = Run(docs.sparkSession, "packing")
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    sized = run.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (words + 1).cast("long").alias("tokens")), "sized")
    starts = F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(sequence).cast("long"))
    pieces = sized.select("doc_id", "tokens", F.posexplode(starts).alias("piece", "start"))
    pieces = pieces.select("doc_id", "tokens", "piece", "start", F.least(F.col("tokens") - F.col("start"), F.lit(sequence)).alias("length"))
    rows = pieces.groupBy("length").count().orderBy("length").collect()  # at most ``sequence`` rows
    lengths = np.array([r["length"] for r in rows], int)
    counts = np.array([r["count"] for r in rows], int)
    ends = boundaries(lengths, counts, buckets)
    if not ends:
        return pieces.drop("tokens").select("*", *[F.lit(None).cast("long").alias(c) for c in ("bucket", "batch_cell", "batch", "slot")])
    bucket = F.lit(ends[-1])
    for end in reversed(ends[:-1]):
        bucket = F.when(F.col("length") <= end, F.lit(end)).otherwise(bucket)
    full = {e: int(counts[np.searchsorted(lengths, lo, "right") : np.searchsorted(lengths, e, "right")].sum()) for lo, e in zip([0, *ends], ends)}
    cells = _pick({e: max(1, -(-n // cell)) for e, n in full.items()}, F.col("bucket"))
    holds = _pick({e: max(1, budget // e) for e in ends}, F.col("bucket"))
    dealt = pieces.withColumn("bucket", bucket)
    dealt = dealt.withColumn("batch_cell", F.coalesce(F.pmod(F.xxhash64("doc_id", "piece", "tokens"), cells), F.lit(0)))
    place = F.row_number().over(
        Window.partitionBy("bucket", "batch_cell").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "piece")
    )
    dealt = dealt.withColumn("place", place.cast("long") - 1).withColumn("holds", holds.cast("long"))
    return dealt.select(
        "doc_id", F.col("piece").cast("long").alias("piece"), "start", "length", F.col("bucket").cast("long").alias("bucket"),
        F.col("batch_cell").cast("long").alias("batch_cell"), F.floor(F.col("place") / F.col("holds")).alias("batch"),
        F.pmod(F.col("place"), F.col("holds")).alias("slot"),
    )


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
