import hashlib
import random

import numpy as np
import pytest
from compare import connect, same
from llm.cases import ODD_TEXTS, documents, prose, words

from waveplan.llm.recompress import anchors
from waveplan.llm.substring import OP1_SQL, op1_substring_dedup, remove_repeats
from waveplan.llm.words import mix, name_of, slices, split
import pyarrow as pa


def plain(rows, window):
    first = {}
    for doc_id, text in rows:
        own = words(text)
        for i in range(len(own) - window + 1):
            key = tuple(own[i : i + window])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        own = words(text)
        gone = set()
        for i in range(len(own) - window + 1):
            if doc_id is not None and first[tuple(own[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        out.append((doc_id, len(own), len(gone), " ".join(w for k, w in enumerate(own) if k not in gone)))
    return sorted(out, key=str)


def check(spark, rows, window):
    got = remove_repeats(documents(spark, rows), window=window).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, window)


def test_splitting_agrees_with_the_pattern():
    make = random.Random(1)
    texts = ODD_TEXTS + ["".join(make.choice("ab é\n\t😀 ") for _ in range(make.randrange(60))) for _ in range(200)]
    column = pa.array(texts, pa.string())
    got = split(column)
    expected = [w for t in texts for w in words(t)]
    assert [got.word(i).decode() for i in range(len(got.start))] == expected
    assert [name_of(w.encode()) for w in expected] == got.name.tolist()
    assert np.diff(got.first).tolist() == [len(words(t)) for t in texts]
    assert [r for r in slices(column, 50)][-1][1] == len(texts)
    # a sliced column reads its own rows only
    assert split(column.slice(3, 5)).name.tolist() == [name_of(w.encode()) for t in texts[3:8] for w in words(t)]


@pytest.mark.parametrize("vocabulary", [1, 2, 3, 8, 50])
@pytest.mark.parametrize("window", [3, 5, 13])
def test_equal_windows_get_equal_keys_whatever_stands_around(vocabulary, window):
    make = np.random.default_rng(vocabulary * 100 + window)
    names = mix(np.arange(1, vocabulary + 1).astype(np.uint64))
    word = names[make.integers(0, vocabulary, 4000)]
    first = np.sort(np.concatenate([[0, 4000], make.integers(0, 4000, 40)]))
    starts, keys = anchors(word, first, window, 2)
    seen = {}
    for s, k in zip(starts.tolist(), keys.tolist()):
        assert seen.setdefault(tuple(word[s : s + window].tolist()), k) == k
    lengths = np.diff(first)
    assert len(starts) == np.maximum(lengths - window + 1, 0).sum()


@pytest.mark.parametrize("vocabulary", [1, 2, 6])
def test_runs_and_repeats(spark, vocabulary):
    make = random.Random(vocabulary)
    rows = [(i, " ".join(str(make.randrange(vocabulary)) for _ in range(make.randrange(40)))) for i in range(40)]
    check(spark, rows, 13)
    check(spark, rows, 4)


def test_odd_rows_copies_and_passages(spark):
    passage = prose(60, 1)
    rows = list(enumerate(ODD_TEXTS)) + [(None, passage), (None, None)]
    rows += [(100 + i, f"{prose(30, 50 + i)} {passage} {prose(30, 90 + i)}") for i in range(20)]
    rows += [(50, prose(100, 7)), (50, prose(100, 7)), (51, prose(100, 7)), (200, prose(20_000, 8)), (201, prose(20_000, 8))]
    check(spark, rows, 13)


def test_empty_table(spark):
    assert remove_repeats(documents(spark, [])).collect() == []


def test_query_equals_sql(spark, small):
    same(op1_substring_dedup(spark, small), connect(small), OP1_SQL)


def test_kept_text_is_hashed_as_it_is(spark, small):
    row = op1_substring_dedup(spark, small).filter("doc_id = 1").first()
    text = spark.read.parquet(f"{small}/documents.parquet").filter("doc_id = 1").first()["text"]
    assert row["kept_sha256"] == hashlib.sha256(" ".join(words(text)).encode()).hexdigest()
