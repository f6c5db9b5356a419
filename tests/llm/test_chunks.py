import time

import numpy as np

from waveplan.llm import chunks


def test_buckets_share_the_keys_evenly_and_in_order():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 10_000, dtype=np.uint64))
    for buckets in (1, 2, 7, 1000, 2**20 + 3):
        got = chunks.bucket_of(keys, buckets)
        assert got.tolist() == [int(k) * buckets >> 64 for k in keys.tolist()]


def test_work_of_a_chunk_does_not_grow_with_the_buckets():
    keys = np.sort(np.random.default_rng(2).integers(0, 2**64, 5000, dtype=np.uint64))
    start = time.perf_counter()
    few = chunks.messages(3, keys, 10, keys)
    many = chunks.messages(3, keys, 4_000_000_000, keys)
    assert time.perf_counter() - start < 2
    assert few.num_rows == 10 and sum(few["n"].to_pylist()) == sum(many["n"].to_pylist()) == 5000
    assert np.frombuffer(b"".join(b[0] for b in many["body"].to_pylist()), np.uint64).tolist() == keys.tolist()
    assert chunks.messages(3, keys[:0], 10).num_rows == 0


def test_sums_are_exact(spark):
    big = np.array([2**40 + 1, 3] * 16)
    parts = spark.range(40, numPartitions=8).mapInArrow(lambda batches: (chunks.sliced(big) for _ in batches), chunks.SLICED)
    batches = sum(1 for r in parts.collect() if r["slice"] == 0)
    assert chunks.summed(parts, len(big)).tolist() == (big * batches).tolist()
