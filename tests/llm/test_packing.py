import itertools

import numpy as np
import pytest
from llm.cases import ODD_TEXTS, documents, prose, words

from waveplan.llm.packing import boundaries, op6_packing, pack, padding


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("buckets", [1, 2, 3, 5])
def test_boundaries_are_the_best(seed, buckets):
    make = np.random.default_rng(seed)
    lengths = np.sort(make.choice(60, 9, replace=False) + 1)
    counts = make.integers(1, 50, 9)
    ends = boundaries(lengths, counts, buckets)
    assert len(ends) <= buckets and ends[-1] == lengths[-1]
    every = (sorted({*c, lengths[-1]}) for c in itertools.combinations(lengths[:-1].tolist(), buckets - 1))
    assert padding(lengths, counts, ends) == min(padding(lengths, counts, e) for e in every)


def test_few_lengths():
    assert boundaries(np.array([], int), np.array([], int), 4) == []
    assert boundaries(np.array([7]), np.array([3]), 4) == [7]
    assert boundaries(np.array([1, 9]), np.array([3, 3]), 4) == [1, 9]


def whole(rows, texts, sequence, budget):
    """Every token stands once, batches hold the budget, places are taken once."""
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, text in texts.items():
        own = sorted(by[i], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(words(text)) + 1, sequence))
        assert sum(r["length"] for r in own) == len(words(text)) + 1
    batches = {}
    for r in rows:
        assert 1 <= r["length"] <= r["bucket"] <= sequence
        batches.setdefault((r["bucket"], r["batch_cell"], r["batch"]), []).append(r["slot"])
    for (bucket, _, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots)))
        assert len(slots) * bucket <= max(budget, bucket)
    return batches


def test_pieces_and_batches(spark):
    texts = dict(enumerate(ODD_TEXTS)) | {100 + i: prose(3 * i, i) for i in range(120)} | {500: prose(1000, 1), 501: prose(999, 1)}
    rows = pack(documents(spark, list(texts.items())), sequence=100, buckets=4, budget=400, cell=32).collect()
    batches = whole(rows, texts, 100, 400)
    # in each cell of a bucket only the last batch may have room
    last = {}
    for bucket, cell, batch in batches:
        last[bucket, cell] = max(last.get((bucket, cell), 0), batch)
    for (bucket, cell, batch), slots in batches.items():
        assert batch == last[bucket, cell] or len(slots) == max(1, 400 // bucket)


def test_odd_rows(spark):
    rows = [(None, "a b"), (None, None), (1, "x y z"), (1, "x y z"), (1, "other")]
    got = pack(documents(spark, rows)).collect()
    assert sorted(r["length"] for r in got) == [1, 2, 3, 4, 4]
    assert pack(documents(spark, [])).collect() == []


def test_query(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    whole(op6_packing(spark, small).collect(), texts, 2048, 65_536)
