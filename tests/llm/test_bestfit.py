import functools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm.cases import ODD_TEXTS, documents, prose

from waveplan.llm.bestfit import Encoder, _Instance, _place, op12_bestfit, pack, plan, ranked, reduce, vocabulary


def bins_of(placements):
    """Contents of each sequence, checked to be gapless from 0."""
    spans = {}
    ranks = {}
    for p in placements:
        for b in range(p.bins):
            for e in range(p.each):
                spans.setdefault(p.first + b, []).append((p.offset + e * p.length, p.length))
        ranks.setdefault(p.length, []).append((p.rank, p.bins * p.each))
    for parts in ranks.values():
        at = 0
        for rank, count in parts:
            assert rank == at
            at += count
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    return [sorted(n for _, n in parts) for parts in spans.values()]


def fewest(items, capacity):
    """Sequences an exact search needs."""

    @functools.lru_cache(None)
    def search(left, room):
        best = None
        for k in range(len(left)):
            if k and left[k] == left[k - 1]:
                continue
            rest = left[:k] + left[k + 1 :]
            if left[k] <= room:
                value = search(rest, room - left[k])
            elif k == 0:
                value = 1 + search(rest, capacity - left[k])
            else:
                continue
            best = value if best is None else min(best, value)
        return best or 0

    return search(tuple(sorted(items, reverse=True)), 0)


@pytest.mark.parametrize("seed", range(120))
def test_reduction_keeps_a_best_packing(seed):
    make = random.Random(seed)
    capacity = make.choice([10, 17, 30])
    low = make.choice([1, capacity // 5, capacity // 4 + 1])
    items = [make.randint(low, capacity) for _ in range(make.randrange(1, 9))]
    items += items[: make.randrange(3)]
    instance = _Instance(dict(Counter(items)), capacity)
    reduce(instance)
    rest = [n for n, c in instance.left.items() for _ in range(c)]
    assert instance.bins + fewest(rest, capacity) == fewest(items, capacity)


@pytest.mark.parametrize("seed", range(40))
def test_every_piece_is_placed_once(seed):
    make = random.Random(seed)
    capacity = make.choice([5, 64, 300])
    histogram = {make.randint(1, capacity): make.randint(1, make.choice([3, 500])) for _ in range(make.randrange(1, 40))}
    placements, bins, fixed = plan(histogram, capacity)
    contents = bins_of(placements)
    assert len(contents) == bins and fixed <= bins
    assert Counter(n for c in contents for n in c) == Counter(histogram)
    assert max(map(sum, contents)) <= capacity
    tokens = sum(n * c for n, c in histogram.items())
    assert -(-tokens // capacity) <= bins <= max(1, tokens * 2 // capacity + 1)


def test_dominating_sets_of_each_kind():
    assert plan({8: 5}, 10)[1:] == (5, 5)  # alone
    assert plan({6: 3, 4: 3}, 10)[1:] == (3, 3)  # filled
    assert plan({7: 1, 2: 1, 9: 1}, 10)[1:] == (2, 2)  # one fits
    assert plan({5: 4}, 10)[1:] == (2, 2)  # two of the same
    assert plan({}, 10) == ([], 0, 0)


def test_placements_do_not_grow_with_the_counts():
    make = random.Random(1)
    histogram = {n: make.randint(1, 50) for n in range(1, 2049)}
    few, many = plan(histogram)[0], plan({n: 10**7 * c for n, c in histogram.items()})[0]
    assert len(few) < 20_000 and len(many) < 20_000


def test_placements_of_alike_triples_do_not_grow_with_the_counts():
    few, bins, fixed = plan({1500: 10**6, 200: 2 * 10**6})
    assert len(few) < 10 and (bins, fixed) == (10**6, 10**6)
    for counts in ({7: 5, 3: 9, 2: 4}, {6: 7, 2: 11}, {5: 4, 3: 3, 2: 20}, {12: 9, 4: 12, 3: 8}):
        assert Counter(n for c in bins_of(plan(counts, 20)[0]) for n in c) == Counter(counts)


def check(spark, docs, capacity, **options):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    expected = Counter()
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        at, piece = 0, 0
        while at < len(ids):
            size = (len(ids) - at - 1) % capacity + 1 if at == 0 else capacity
            part = np.array(ids[at : at + size], "<u4").tobytes()
            expected[doc_id, piece, at, size, zlib.crc32(part)] += 1
            at, piece = at + size, piece + 1
    rows = pack(documents(spark, docs), capacity=capacity, **options).collect()
    assert Counter(tuple(r)[:5] for r in rows) == expected
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(spans) == (plan(Counter(r.length for r in rows), capacity)[1] if rows else 0)


def test_odd_texts_repeats_and_cut_documents(spark):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "a b"), (None, None), (3, "same"), (3, "same"), (3, "other")]
    rows += [(100 + i, prose(3 * i, i)) for i in range(30)]
    check(spark, rows, 64)
    check(spark, rows, 64, cell=3)
    check(spark, rows, 2048)


def test_very_long_text_and_many_copies(spark):
    check(spark, [(1, prose(60_000, 1)), *[(i, "one two three") for i in range(2, 300)]], 256, cell=20)


def test_empty_table(spark):
    check(spark, [], 64)


def test_stretches_have_the_ids_of_the_whole_text():
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(vocabulary()), Encoder(vocabulary())
    make = random.Random(7)
    signs = [chr(c) for c in range(0x250)]
    fast = ["".join(make.choice(signs) for _ in range(60)) for _ in range(3000)] + [f"{a}{b}{a} {b}" for a in signs for b in " \n\x85\u00a0\u00e9"]
    signs = [" ", " ", "  ", "\n", "\t", "\u00a0", "\x85", "\u2003", "\x1c", "a", "b", "Z", "é", "漢", "1", "23", "'s", "'", "!", "<|endoftext|>", "<|", "_", "\r\n ", "\x00", "😀", "\u0301"]
    texts = ["".join(make.choice(signs if make.random() < 0.9 else ["word", " and"]) for _ in range(make.randrange(1, 40))) for _ in range(4000)]
    for text in [*texts, *fast, *[t or "" for t in ODD_TEXTS], "x" * 100_000, " " * 5000 + "a"]:
        expected = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert own.encode(text) == expected, text


def test_other_tokenizers_are_asked_for_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Encoder(path)
    assert own.fast is None and Encoder(vocabulary()).fast is not None
    ids = Tokenizer.from_file(path).encode("Two words, é", add_special_tokens=False).ids
    assert own.encode("Two words, é") == np.array(ids, "<u4").tobytes()


def test_lookup_of_ranks():
    import pyarrow as pa

    histogram = {3: 10, 5: 7, 2: 9}
    placements, _, _ = plan(histogram, 10)
    length = np.repeat(list(histogram), list(histogram.values()))
    rank = np.concatenate([np.arange(c) for c in histogram.values()])
    n = len(length)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n)), *[pa.array(np.zeros(n, int))] * 2, pa.array(length), pa.array(np.zeros(n, int)), pa.array(rank)],
        ["doc_id", "piece", "start", "length", "ids_crc32", "rank"],
    )
    (got,) = _place(placements)([batch])
    contents = {}
    for s, o, size in zip(got["sequence_id"].to_pylist(), got["offset"].to_pylist(), length.tolist()):
        contents.setdefault(s, []).append((o, size))
    assert sorted(sorted(x for _, x in c) for c in contents.values()) == sorted(bins_of(placements))


def test_many_lengths_outgrow_a_cell(spark):
    """As in a large table, where most lengths have more pieces than a cell."""
    from pyspark.sql import functions as F

    lengths = 1500
    rows = spark.range(3 * lengths).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        (F.col("id") % lengths + 1).alias("length"), F.col("id").alias("ids_crc32"),
    )
    ranks = {}
    for r in ranked(rows, 2).collect():
        ranks.setdefault(r["length"], []).append(r["rank"])
    assert len(ranks) == lengths and all(sorted(x) == [0, 1, 2] for x in ranks.values())


def test_query_packs_all_documents(spark, small):
    rows = op12_bestfit(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").count()
    assert len({r.doc_id for r in rows}) == docs
    tokens = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-tokens // 2048) * 1.02 + 2
