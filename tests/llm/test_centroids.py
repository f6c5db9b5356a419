import hashlib
import math
import random

import numpy as np
import pytest
from compare import connect, same

from waveplan.llm import centroids
from waveplan.llm.centroids import OP11_SQL, cluster, nearest, op11_centroids, restore, transform, walsh


def plain(rows, count=8, rounds=10):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v]))
    drawn = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())
    centres = [v for _, v in sorted(kept, key=drawn)[:count]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    choose = lambda v: min((far(v, c), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(choose(v)[1], []).append(v)
        centres = [[sum(x) // len(members[k]) for x in zip(*members[k])] if k in members else c for k, c in enumerate(centres)]
    return sorted(((i, k, d) for i, v in kept for d, k in [choose(v)]), key=str), centres


def check(spark, rows, **options):
    table = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, cluster string, w string")
    found, centres = cluster(table, **options)
    expected, exact = plain(rows)
    assert sorted(map(tuple, found.collect()), key=str) == expected
    assert centres.tolist() == exact


def test_transform_is_exact_and_coarse_first():
    h = walsh()
    assert (h @ h.T == 64 * np.eye(64, dtype=int)).all()
    assert ((h[:, 1:] != h[:, :-1]).sum(1) == np.arange(64)).all()
    x = np.random.default_rng(1).integers(-5000, 5000, (50, 64))
    assert (restore(transform(x)) == x).all()


def test_search_equals_all_distances_and_breaks_ties():
    make = np.random.default_rng(2)
    x = make.integers(-3, 3, (400, 64))
    centres = np.concatenate([x[:3], x[:3], make.integers(-3, 3, (2, 64))])  # every centroid of three stands twice
    number, distance = nearest(transform(x), transform(centres))
    all_of_them = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (number == all_of_them.argmin(1)).all() and (distance == all_of_them.min(1)).all()


def test_clusters_of_points_around_centres(spark):
    make = random.Random(3)
    middles = [[make.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    check(spark, [(i, [x + make.gauss(0, 0.3) for x in middles[i % 5]]) for i in range(200)])


def test_odd_vectors_repeats_and_empty_clusters(spark):
    make = random.Random(4)
    one = [make.gauss(0, 1) for _ in range(64)]
    rows = [(i, one) for i in range(12)]  # eight equal centroids, seven of them empty
    rows += [(5, [-x for x in one]), (None, [2 * x for x in one])]
    rows += [(100, None), (101, []), (102, one[:63]), (103, [*one, 1.0]), (104, [None, *one[1:]])]
    rows += [(105, [math.nan, *one[1:]]), (106, [math.inf, *one[1:]])]
    check(spark, rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    check(spark, [(1, [0.5] * 64), (2, [-0.25] * 64)])
    check(spark, [])


def test_large_components_are_exact_and_distances_beyond_a_long_an_error(spark):
    make = random.Random(5)
    check(spark, [(i, [make.uniform(-1, 1) * 2e5 for _ in range(64)]) for i in range(30)])
    with pytest.raises(Exception, match="(?i)too large|overflow"):
        check(spark, [(1, [1e15] * 64), (2, [-1e15] * 64), (3, [1e18] * 64)])


def test_empty_table_has_all_columns(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op11_centroids(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and not got.count()


def test_query_equals_sql(spark, small):
    same(op11_centroids(spark, small), connect(small), OP11_SQL)


def test_all_coefficients_are_finished():
    assert centroids.STEPS[-1] == centroids.SIZE
