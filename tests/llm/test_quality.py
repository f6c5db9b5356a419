import random

import numpy as np
import pyarrow as pa
from llm.cases import ODD_TEXTS, documents, prose, words
from pyspark.sql import functions as F

from waveplan.llm.quality import counts, grams, judge_quality, keep_good, op4_quality, train
from waveplan.llm.words import split

LABELS = "doc_id long, quality int, toxic int"


def plain(text):
    own = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return {
        "n_words": len(own),
        "word_chars": sum(map(len, own)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def test_counts_agree_with_plain_ones():
    make = random.Random(4)
    texts = ODD_TEXTS + ["".join(make.choice("ab #*\n\té|<") for _ in range(make.randrange(200))) for _ in range(200)]
    column = pa.array(texts, pa.string())
    got = counts(column, split(column))
    for i, text in enumerate(texts):
        assert {k: int(v[i]) for k, v in got.items()} == plain(text), repr(text)


def test_grams_stay_inside_their_text():
    texts = ["ab", "", "abcd e", None, "x", "abc"]
    together = [[s[a:b].tolist() for a, b in zip(e, e[1:])] for s, e in grams(split(pa.array(texts, pa.string())))]
    for i, text in enumerate(texts):
        alone = [s.tolist() for s, _ in grams(split(pa.array([text], pa.string())))]
        assert [kind[i] for kind in together] == alone


def test_labels_decide_and_clean_texts_stay(spark, medium):
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    out = op4_quality(spark, medium).join(labels, "doc_id").filter("NOT base_failed")
    good, bad = out.filter("quality = 1"), out.filter("quality = 0")
    assert good.filter("kept").count() >= 0.98 * good.count()
    assert bad.filter("kept").count() <= 0.1 * bad.count()


def test_unlabelled_texts_are_judged_by_what_was_learnt():
    good = [prose(80, i) for i in range(60)]
    bad = [" ".join(f"{w}$$$" for w in prose(80, 100 + i).split()) for i in range(60)]
    model = train(good[:45] + bad[:45], np.array([1.0] * 45 + [0.0] * 45))
    p = model.probabilities(split(pa.array(good[45:] + bad[45:] + [None, ""], pa.string())))
    assert (p[:15] > 0.5).all() and (p[15:30] < 0.5).all() and np.isfinite(p).all()


def test_odd_rows_and_labels(spark):
    rows = list(enumerate(ODD_TEXTS)) + [(20, prose(200, 1)), (20, prose(200, 1)), (None, prose(60, 2)), (30, "same three words " * 40)]
    docs = documents(spark, rows)
    for marks in ([], [(20, 1, 0)], [(20, 1, 0), (20, None, 0), (None, 0, 0), (99, 0, 1), (30, 7, 0)]):
        labels = spark.createDataFrame(marks, LABELS)
        got = judge_quality(docs, labels).collect()
        assert len(got) == len(rows)
        by = {r["doc_id"]: r for r in got}
        for i, text in enumerate(ODD_TEXTS):
            assert {k: by[i][k] for k in plain(text)} == plain(text)
            assert by[i]["base_failed"] and not by[i]["kept"]
        assert by[20]["kept"] and by[None]["kept"] and not by[30]["kept"] and by[30]["base_failed"]
        kept = keep_good(docs, labels)
        assert kept.schema == docs.schema
        assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 20, 20]
    assert judge_quality(documents(spark, []), labels).collect() == []


def test_same_verdict_in_both_forms(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    ids = {r["doc_id"] for r in judge_quality(docs, labels).filter(F.col("kept")).collect()}
    assert {r["doc_id"] for r in keep_good(docs, labels).collect()} == ids
