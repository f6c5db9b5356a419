"""Centroid clustering with a Walsh-Hadamard progressive search for the nearest centroid.

Vectors and centroids are sent through the 64-point Walsh-Hadamard transform H, whose rows are
ordered by their sign changes, coarse first. H is integer and H'H = 64 I, so 64 times a
squared distance is the sum of the squared differences of the 64 coefficients. A vector adds
up these differences a few coefficients at a time. After each step the centroid that looks
nearest gets its whole distance; centroids whose partial sum already is above the least whole
distance known are strictly worse and fall out, and the others go on. What is left after all
64 coefficients is exact, so ties are seen as ties and go to the smaller number.

Only the transformed vectors are written; each round reads them once. A task adds up its
clusters' coefficients, one row per cluster and coefficient (512 rows), which Spark adds up over all tasks. The
transform of a sum is the sum of transforms, so new centroids follow from these 512 numbers
alone. Nothing else comes to the driver, and a round restarts from the written vectors.

Defined results: a vector that is null, has not exactly 64 components, or holds a null, NaN
or infinite one takes no part; rows that repeat an id are vectors of their own; a null id is
kept, but starts a centroid only if ids are too few; fewer vectors than centroids give fewer
centroids; no vectors give an empty table. Large components are worked on as Python integers;
a distance that no long can hold is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveplan.llm.store import Run, read
from waveplan.llm.topk import whole

SIZE = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SEED = 3
#: Coefficients looked at before each elimination; the last step ends with all of them.
STEPS = (2, 8, 24, SIZE)
#: Coefficients up to here have differences whose 64 squares add up within 63 bits.
_SAFE = 1 << 27
#: Components up to here have coefficients within 63 bits.
_LARGEST = 1 << 56


def walsh(size: int = SIZE) -> np.ndarray:
    """The Hadamard matrix of ``size`` (a power of two), rows by rising number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(1))]


def transform(x: np.ndarray) -> np.ndarray:
    """Exact coefficients of the rows of integers."""
    return x @ walsh(x.shape[1]).T


def restore(w: np.ndarray) -> np.ndarray:
    """The rows whose coefficients these are."""
    return w @ walsh(w.shape[1]) // w.shape[1]


def nearest(w: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row and the squared distance, all as coefficients."""
    n, k = len(w), len(centroids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if max(np.abs(w).max(), np.abs(centroids).max()) > _SAFE:
        w, centroids = w.astype(object), centroids.astype(object)
    row, centre = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    partial = np.zeros(n * k, w.dtype)
    least = None
    at = 0
    for step in STEPS:
        apart = w[row, at:step] - centroids[centre, at:step]
        partial += (apart * apart).sum(1)
        at = step
        if step == SIZE:
            break
        first = np.searchsorted(row, np.arange(n))
        best = np.minimum.reduceat(partial, first)
        guess = np.flatnonzero(partial == best[row])
        guess = guess[np.searchsorted(row[guess], np.arange(n))]
        rest = w[:, at:] - centroids[centre[guess], at:]
        whole_distance = best + (rest * rest).sum(1)
        least = whole_distance if least is None else np.minimum(least, whole_distance)
        alive = partial <= least[row]
        row, centre, partial = row[alive], centre[alive], partial[alive]
    best = np.minimum.reduceat(partial, np.searchsorted(row, np.arange(n)))
    winner = np.flatnonzero(partial == best[row])
    winner = winner[np.searchsorted(row[winner], np.arange(n))]
    return centre[winner], (best // SIZE).astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), SIZE)


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch["vector"])
        if len(x) and max(int(x.max()), -int(x.min())) > _LARGEST:
            raise OverflowError("components too large for 64 bits")
        w = pa.FixedSizeListArray.from_arrays(pa.array(transform(x).ravel()), SIZE).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch["vec_id"], w], ["vec_id", "w"])


def _sums(centroids: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors and coefficient sums of each cluster, over all batches of the task."""
        k = len(centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, SIZE), object)
        for batch in batches:
            w = _matrix(batch["w"])
            cluster, _ = nearest(w, centroids)
            count += np.bincount(cluster, minlength=k)
            for c in range(k):
                total[c] += w[cluster == c].sum(0)
        cluster, place = np.divmod(np.arange(k * SIZE), SIZE)
        sums = pa.array([str(x) for x in total.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(place), pa.array(count[cluster]), sums], ["cluster", "place", "n", "total"])

    return add


def _assigned(centroids: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(_matrix(batch["w"]), centroids)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"]
            )

    return assign


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the floor of the mean of each cluster's vectors; an empty cluster stays."""
    found = vectors.mapInArrow(_sums(transform(centroids)), "cluster long, place long, n long, total string")
    sums = found.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    count, total = np.zeros(len(centroids), object), np.zeros((len(centroids), SIZE), object)
    for r in sums.collect():  # 64 rows for each centroid
        count[r["cluster"]], total[r["cluster"], r["place"]] = r["n"], int(r["total"])
    exact = total @ walsh().astype(object) // SIZE
    mean = [[x // n for x in row] if n else list(old) for row, n, old in zip(exact, count, centroids)]
    return np.array(mean, np.int64).reshape(-1, SIZE)


def cluster(
    vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and squared distance of every vector, and the centroids themselves."""
    run = Run(vectors.sparkSession, "centroids")
    table = vectors.filter(F.size("embedding") == SIZE)
    table = table.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding"), scale).alias("vector"))
    kept = run.keep(table.filter("vector IS NOT NULL").mapInArrow(_transformed, "vec_id long, w array<long>"), "vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(drawn.asc_nulls_last(), "w").limit(centroids).collect()
    centres = restore(np.array([r["w"] for r in first], np.int64).reshape(-1, SIZE))
    for _ in range(rounds if len(centres) else 0):
        centres = moved(kept, centres)
    found = kept.mapInArrow(_assigned(transform(centres)), "vec_id long, cluster int, distance long")
    return run.keep(found, "assigned"), centres


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    found, centres = cluster(read(spark, sf_dir, "embeddings"))
    total = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    if not total:
        nothing = [("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")]
        return found.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in nothing])
    by = lambda values: F.element_at(F.create_map(*[x for c, v in values.items() for x in (F.lit(c), F.lit(v))]), F.col("cluster"))
    return found.select(
        "vec_id", "cluster", "distance",
        by(total).cast("long").alias("cluster_inertia"), F.lit(sum(total.values())).cast("long").alias("inertia"),
        by({c: digest(centres[c]) for c in total}).alias("centroid_sha256"),
    )


def _sql(centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> str:
    distance = "CAST(list_sum(list_transform(list_zip(v, x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS cluster, v AS x FROM v
  QUALIFY cluster < {centroids}
)""",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'distance': {distance}, 'cluster': cluster}}) AS best
  FROM v, c{k} GROUP BY row
)"""
        )
        if k < rounds:
            steps.append(
                f"""s{k} AS (
  SELECT cluster, place, sum(x) AS total, count(*) AS n
  FROM (SELECT best.cluster AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{k}) GROUP BY cluster, place
), c{k + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN (
    SELECT cluster, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY place) AS x FROM s{k} GROUP BY cluster
  ) n USING (cluster)
)"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, best.distance AS distance,
  CAST(sum(best.distance) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON best.cluster = cluster"""


OP11_SQL = _sql()
