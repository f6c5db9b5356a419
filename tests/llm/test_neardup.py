import random

import numpy as np
import pyarrow as pa
from llm.cases import ODD_TEXTS, documents, prose, words

from waveplan.llm import neardup
from waveplan.llm.words import split


def shingled(text):
    own = words(text)
    return frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else frozenset()


def classes(texts, weight, least=0.8):
    """Classes by all pairs: label of each text is its smallest index."""
    weighed = [{s: weight(s, text) for s in shingled(text)} for text in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(weighed):
        for j in range(i):
            b = weighed[j]
            if not a or not b:
                continue
            low = sum(min(a.get(s, 0), b.get(s, 0)) for s in a.keys() | b.keys())
            high = sum(max(a.get(s, 0), b.get(s, 0)) for s in a.keys() | b.keys())
            if low / high >= least:
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [root(i) for i in range(len(texts))]


def tf_idf(texts):
    """The operator's weights, computed in another way."""
    import math

    names = {w: int(split(pa.array([w])).name[0]) >> (64 - neardup.IDF_BITS) for t in texts for w in words(t)}
    seen = {}
    for t in texts:
        for s in {names[w] for w in words(t)}:
            seen[s] = seen.get(s, 0) + 1
    n = sum(bool(words(t)) for t in texts)
    idf = lambda w: 2 - math.log(seen[names[w]] + 1) / math.log(n + 1)

    def weight(shingle, text):
        own = words(text)
        k = len(shingle)
        times = sum(tuple(own[i : i + k]) == shingle for i in range(len(own) - k + 1))
        return times * sum(map(idf, shingle)) / k

    return weight


def changed(text, places, seed):
    make, own = random.Random(seed), text.split()
    for _ in range(places):
        own[make.randrange(len(own))] = f"new{make.randrange(10**6)}"
    return " ".join(own)


def fixture():
    texts = [prose(150, i, 3000) for i in range(30)]
    for i in range(8):  # near copies of near copies
        texts += [changed(texts[i], k, 10 * i + k) for k in (1, 2, 3, 5, 8, 20)]
    chain = prose(200, 999, 3000)
    for k in range(6):
        texts.append(chain)
        chain = changed(chain, 3, 7000 + k)
    texts += [texts[3], "  ".join(texts[3].split()), texts[4] + "\n"]
    passage = prose(60, 555, 3000)
    texts += [f"{prose(120, 2000 + i, 3000)} {passage}" for i in range(20)]
    texts += ["a b", "a b", "a  b", "a c", "x " * 300, "x " * 290, "one two three four five", "one two three four five"]
    return texts


def test_classes_agree_with_all_pairs(spark):
    texts = fixture()
    got = neardup.near_duplicates(documents(spark, list(enumerate(texts)))).collect()
    mine = {r["doc_id"]: r["class_id"] for r in got}
    assert [mine[i] for i in range(len(texts))] == classes(texts, tf_idf(texts))


def test_odd_rows(spark):
    rows = list(enumerate(ODD_TEXTS)) + [(None, "one"), (None, None), (30, "one"), (31, prose(90, 1)), (31, prose(90, 1))]
    docs = documents(spark, rows)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["class_id"] for r in got}
    assert by[None] is None and by[30] == 3 and by[31] == 31
    assert [by[i] for i in range(10)] == list(range(10))
    kept = neardup.keep_first(docs)
    assert kept.schema == docs.schema
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in kept.collect()) == [-1, -1, *range(10), 31]
    assert neardup.near_duplicates(documents(spark, [])).collect() == []
    assert neardup.keep_first(documents(spark, [])).collect() == []


def test_large_group_of_near_copies(spark):
    text = prose(200, 5, 3000)
    rows = [(i, changed(text, 1 + i % 3, i)) for i in range(400)] + [(1000 + i, prose(200, 50 + i, 3000)) for i in range(50)]
    got = neardup.near_duplicates(documents(spark, rows)).collect()
    assert {r["class_id"] for r in got if r["doc_id"] < 400} == {0}
    assert sorted(r["class_id"] for r in got if r["doc_id"] >= 1000) == list(range(1000, 1050))


def test_samples_agree_as_often_as_texts_are_similar():
    """The share of equal samples estimates the weighted Jaccard similarity."""
    texts = [prose(400, 1, 5000)]
    texts += [changed(texts[0], k, k) for k in (5, 20, 60)]
    idf = np.ones(1 << neardup.IDF_BITS, np.float32)
    name, weight, first = neardup.shingles(split(pa.array(texts)), idf)
    old, rows = neardup.BANDS, neardup.ROWS
    try:
        neardup.BANDS, neardup.ROWS = 200, 1
        keys, _ = neardup.sample_bands(name, weight, first)
    finally:
        neardup.BANDS, neardup.ROWS = old, rows
    one = lambda i: (name[first[i] : first[i + 1]], weight[first[i] : first[i + 1]])
    for i in (1, 2, 3):
        assert abs((keys[0] == keys[i]).mean() - neardup.similarity(one(0), one(i))) < 0.12


def templates():
    """Many classes that share most of a text, and pairs of copies whose buckets all are full of them."""
    passage = prose(120, 777, 3000)
    texts = [f"{prose(12, 4000 + i, 3000)} {passage}" for i in range(60)]
    for i in range(30):
        text = f"{prose(12, 5000 + i, 3000)} {passage}"
        texts += [text, changed(text, 2, 6000 + i)]
    return texts


def test_large_buckets_of_many_classes_agree_with_all_pairs(spark):
    texts = templates()
    got = neardup.near_duplicates(documents(spark, list(enumerate(texts)))).collect()
    mine = {r["doc_id"]: r["class_id"] for r in got}
    assert [mine[i] for i in range(len(texts))] == classes(texts, tf_idf(texts))


def test_pairs_that_share_one_bucket_away_from_its_centre(spark):
    """b reaches 0.8 with a only, shares one bucket with it, and c is that bucket's centre."""
    for seed in (240, 586, 944):
        a = prose(100, seed, 3000)
        texts = [a, changed(a, 2, seed), changed(a, 2, seed + 10**6)]
        assert classes(texts, tf_idf(texts)) == [0, 0, 0]
        for ids in ((0, 1, 2), (2, 1, 0)):  # either a or c is the centre
            got = neardup.near_duplicates(documents(spark, list(zip(ids, texts)))).collect()
            assert {r["class_id"] for r in got} == {0}


def test_pairs_whose_samples_hardly_agree_are_compared(spark):
    """They share a bucket, but fewer than AGREE samples."""
    for seed in (1560, 4690):
        text = prose(60, seed, 3000)
        texts = [text, changed(text, 1 + seed % 2, seed)]
        assert classes(texts, tf_idf(texts)) == [0, 0]
        got = neardup.near_duplicates(documents(spark, list(enumerate(texts)))).collect()
        assert {r["class_id"] for r in got} == {0}


def test_planted_copies_in_the_tables(spark, medium):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    got = neardup.op5_neardup(spark, medium).collect()
    assert len(got) == len(docs)
    by_text, members = {}, {}
    for r in got:
        assert by_text.setdefault(docs[r["doc_id"]], r["class_id"]) == r["class_id"]
        members.setdefault(r["class_id"], []).append(r["doc_id"])
    sets = {i: shingled(t) for i, t in docs.items()}
    for ids in members.values():
        for i in ids[1:]:
            assert max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in ids if j != i) > 0.7


def test_rows_of_one_id_with_different_texts_all_stay(spark):
    one, two, three = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(1, one), (1, two), (2, three), (2, three), (5, two), (4, one + " end"), (6, ""), (6, None), (None, one)]
    kept = sorted(((r.doc_id, r.text) for r in neardup.keep_first(documents(spark, rows)).collect()), key=str)
    assert kept == sorted([(1, one), (1, two), (2, three), (6, ""), (6, None), (None, one)], key=str)
    found = neardup.near_duplicates(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id) for r in found if r.doc_id) == [(1, 1), (1, 1), (2, 2), (2, 2), (4, 1), (5, 1), (6, 6), (6, 6)]


def test_a_centre_meets_a_node_once_in_the_first_round(spark, monkeypatch):
    from waveplan.llm import neardup

    plans, keep = [], neardup.Run.keep
    seen = lambda self, df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or keep(self, df, name)
    monkeypatch.setattr(neardup.Run, "keep", seen)
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(w if (i * 7 + k) % 31 else f"x{k}" for i, w in enumerate(words))) for k in range(12)]
    neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert "array_intersect" in dict(plans)["new2"]
