"""Exact top-k search by inner product with multi-resolution segment statistics.

Take the distance of a query and a row as their negative inner product. Cut both into
segments of L components with mean m and deviation s; then in each segment the product is at
most L * (m_q * m_x + s_q * s_x) (Cauchy-Schwarz on what is left beside the means). So the
sums over few wide segments, then over more narrow ones, bound the distance from below. A
row falls out for a query once its bound is beyond the query's k-th best exact distance so
far; what is left gets exact distances. Ties survive, as only worse bounds fall out.

Queries and rows are dealt to blocks by a hash and every query block meets every row block:
the stated queries against all rows, with memory bounded by a block of each. Best lists of
blocks are merged by query.

Components are floor(64 * x) of the double x; scores are their integer inner products.
Defined results: a vector that is null, or holds a null, NaN or infinite component, takes no
part, nor does a row without id; vectors are compared with those of their own length; rows
that repeat an id are queries and candidates of their own, so a repeated query id has a list for
each of its rows; no vectors give an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveplan.llm.store import Run, read

K = 20
SCALE = 64
SEGMENTS = (4, 16)
QUERY_BLOCK = 4096
ROW_BLOCK = 8192
#: Queries looked at together inside a block; bounds the matrix of bounds.
_AT_ONCE = 256
_FOUND = "query_row long, query_id long, vec_id long, score long"


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, or null for a vector that takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * scale)))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, times the root of its length, side by side."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, max(1, x.shape[1])))
    out = []
    for part in parts:
        own, n = x[:, part], max(1, len(part))
        mean = own.sum(1) / n
        spread = np.sqrt(np.maximum(((own - mean[:, None]) ** 2).sum(1), 0.0))
        out += [mean * np.sqrt(n), spread]
    return np.stack(out, 1)


def search(query_rows, queries, row_rows, row_ids, rows, k: int) -> list[np.ndarray]:
    """The k best rows (ids rising) of each query but itself: numbers of queries in the block, row ids, scores."""
    big = max(np.abs(queries).max(initial=0), np.abs(rows).max(initial=0))
    # products of doubles are exact up to 2 ** 53
    exact = np.float64 if big * big * max(1, rows.shape[1]) < 2**53 else np.int64
    near, far = queries.astype(float), rows.astype(float)
    own_rows, own_queries = rows.astype(exact), queries.astype(exact)
    levels = [(statistics(near, m), statistics(far, m)) for m in SEGMENTS]
    found = [[], [], []]
    for a in range(0, len(query_rows), _AT_ONCE):
        part = slice(a, a + _AT_ONCE)
        own, q = query_rows[part], own_queries[part]
        other = own[:, None] != row_rows[None, :]
        bound = levels[0][0][part] @ levels[0][1].T
        bound[~other] = -np.inf
        take = min(2 * k, len(row_ids))
        first = np.argpartition(-bound, take - 1, axis=1)[:, :take]
        score = np.einsum("qd,qtd->qt", q, own_rows[first]).astype(float)
        score[~np.take_along_axis(other, first, 1)] = -np.inf
        least = np.sort(score, 1)[:, -min(k, take)][:, None]
        if take < k:
            least[:] = -np.inf
        slack = 1e-9 * (1 + np.abs(least))
        slack[~np.isfinite(slack)] = 0
        alive = other & (bound >= least - slack - 1e-9 * np.abs(bound))
        for near_stats, far_stats in levels[1:]:
            columns = np.flatnonzero(alive.any(0))
            bound = near_stats[part] @ far_stats[columns].T
            alive[:, columns] &= bound >= least - slack - 1e-9 * np.abs(bound)
        columns = np.flatnonzero(alive.any(0))
        score = q @ own_rows[columns].T
        alive = alive[:, columns]
        for i in range(len(own)):
            at = np.flatnonzero(alive[i])
            if not len(at):
                continue
            best = score[i, at].astype(np.int64)
            order = np.argsort(-best, kind="stable")[:k]  # ids rise, so ties go to the smaller
            found[0].append(np.full(len(order), a + i))
            found[1].append(row_ids[columns[at[order]]])
            found[2].append(best[order])
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]


def _meet(k: int):
    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        def opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids = table["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            flat = table["vector"].combine_chunks()
            flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
            return table["row"].to_numpy()[order], ids[order], flat.flatten().to_numpy().reshape(len(ids), -1)[order]

        if not queries.num_rows or not rows.num_rows:
            return pa.table(dict.fromkeys(("query_row", "query_id", "vec_id", "score"), np.zeros(0, np.int64)))
        query_rows, query_ids, asked = opened(queries)
        number, vec_id, score = search(query_rows, asked, *opened(rows), k)
        number = number.astype(np.int64)
        return pa.table({"query_row": query_rows[number], "query_id": query_ids[number], "vec_id": vec_id, "score": score})

    return meet


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK
) -> DataFrame:
    """query_id, rank, vec_id and score; ``is_query`` is a condition on vec_id."""
    run = Run(vectors.sparkSession, "topk")
    table = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding")).alias("vector"))
    table = table.filter("vec_id IS NOT NULL AND vector IS NOT NULL").withColumn("query", is_query)
    # the number of a row is fixed by being written
    table = table.withColumns({"length": F.size("vector"), "row": F.monotonically_increasing_id()})
    table = run.keep(table, "vectors")
    row = table.agg(F.count("*").alias("rows"), F.count_if("query").alias("queries")).first()
    row_blocks = max(1, -(-row["rows"] // row_block))
    query_blocks = max(1, -(-row["queries"] // query_block))
    deal = lambda blocks, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    queries = table.filter("query").withColumn("q", deal(query_blocks, 1)).withColumn("r", every(row_blocks))
    rows = table.withColumn("r", deal(row_blocks, 2)).withColumn("q", every(query_blocks))
    keys, columns = ("length", "q", "r"), ("length", "q", "r", "row", "vec_id", "vector")
    found = queries.select(*columns).groupBy(*keys).cogroup(rows.select(*columns).groupBy(*keys)).applyInArrow(_meet(k), _FOUND)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op2_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP2_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.row AS row, q.vec_id AS query_id, r.vec_id AS vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v r ON q.row <> r.row AND len(q.v) = len(r.v)
  WHERE q.vec_id % 20 = 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM n WHERE rank <= 20
"""
