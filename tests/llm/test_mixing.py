import random

import numpy as np
from llm.cases import ODD_TEXTS, documents, prose, words

from waveplan.llm.mixing import flight, mix_sources, mixed, op7_mixing, settle


def reshared(sizes):
    """Targets by handing on the excess, again and again."""
    total, n = sum(sizes), len(sizes)
    weight = [(1.0, 2.0, 3.0)[i % 3] for i in range(n)]
    capped = [False] * n
    while True:
        free = [i for i in range(n) if not capped[i]]
        left = total - sum(3 * sizes[i] for i in range(n) if capped[i])
        share = {i: left * weight[i] / sum(weight[j] for j in free) for i in free}
        over = [i for i in free if share[i] > 3 * sizes[i]]
        if not over:
            return [3 * sizes[i] if capped[i] else share[i] for i in range(n)]
        for i in over:
            capped[i] = True


def check(rows, source_of, size_of):
    sizes, taken, target, whole = {}, {}, {}, {}
    for r in rows:
        s = source_of(r)
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["size"] * r["copies"]
        target[s], whole[s] = r["target"], r["source_size"]
        assert 0 <= r["copies"] <= 3
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    assert [whole[s] for s in order] == [sizes[s] for s in order]
    assert np.allclose([target[s] for s in order], reshared([sizes[s] for s in order]), rtol=1e-9)
    return {s: (taken[s], target[s]) for s in order}


def test_totals_come_near_the_targets(spark, medium):
    rows = mix_sources(spark.read.parquet(f"{medium}/documents.parquet")).collect()
    for taken, target in check(rows, lambda r: r["source"], None).values():
        assert abs(taken - target) <= 0.02 * target + 20
    again = mix_sources(spark.read.parquet(f"{medium}/documents.parquet").repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_many_cells(spark):
    make = random.Random(7)
    docs = documents(spark, [(i, "w " * make.randrange(1, 60), None, make.choice("abc") if i % 3 else "hot") for i in range(1500)])
    rows = mix_sources(docs, cell=40).collect()
    assert len(rows) == 1500
    for taken, target in check(rows, lambda r: r["source"], None).values():
        assert abs(taken - target) <= 20


def test_odd_rows(spark):
    rows = [(i, t, None, s) for i, t in enumerate(ODD_TEXTS) for s in ("b", "é", None, "", "B")]
    rows += [(7, "x y", None, "b")] * 3 + [(None, "x y z", None, "b")] * 2 + [(90, "", None, "empty"), (91, None, None, "empty")]
    docs = documents(spark, rows)
    got = mix_sources(docs).collect()
    assert sorted(r["size"] for r in got) == sorted(len(words(t)) for _, t, *_ in rows)
    check(got, lambda r: r["source"], None)
    out = mixed(docs)
    assert out.schema == docs.schema
    per = lambda rows, n: sorted((str(r[0]), str(r[1]), n(r)) for r in rows)
    assert sum(len(words(r["text"])) for r in out.collect()) == sum(r["size"] * r["copies"] for r in got)
    assert {r["source"] for r in got if r["source_size"] == 0} == {"empty"}
    assert mix_sources(documents(spark, [])).collect() == [] and mixed(documents(spark, [])).collect() == []
    assert per([], len) == []
    assert {r["copies"] for r in mix_sources(documents(spark, [(1, None), (2, "")])).collect()} == {0}


def test_flight_keeps_totals_until_the_landing():
    make = np.random.default_rng(1)
    size, p = make.integers(1, 500, 3000), make.random(3000)
    moved = flight(size, p, np.random.default_rng(2))
    left = (moved > 0) & (moved < 1)
    assert left.sum() <= 2
    assert np.isclose(moved.sum(), p.sum()) and np.isclose((moved * size).sum(), (p * size).sum())
    landed = settle(size, p, np.random.default_rng(2))
    assert set(landed) <= {0.0, 1.0} and abs(((landed - p) * size).sum()) <= 5
    same = settle(np.full(50, 3), np.full(50, 0.5), np.random.default_rng(3))
    assert same.sum() == 25


def test_flight_follows_the_probabilities():
    size, p = np.array([5, 9, 2, 7, 7, 1, 30]), np.array([0.1, 0.9, 0.5, 0.3, 0.3, 0.6, 0.2])
    mean = np.mean([flight(size, p, np.random.default_rng(s)) for s in range(4000)], 0)
    assert np.abs(mean - p).max() < 0.04


def test_query(spark, small):
    for r in op7_mixing(spark, small).collect():
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    assert prose(3, 1)
