from llm.cases import ODD_TEXTS, documents
from pyspark.sql import functions as F

from waveplan.llm import language
from waveplan.llm.language import WINDOW, cut, identify, learn, op3_language, train

import zlib

import numpy as np


def test_held_out_texts_get_their_language(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    out = op3_language(spark, medium).join(docs, "doc_id").cache()
    assert out.count() == docs.count()
    for row in out.collect():
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1
    held = out.filter("held_out")
    assert held.filter(F.col("lang") == F.col("lang_pred")).count() >= 0.97 * held.count()


def test_odd_texts_and_what_is_no_input(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    net = learn(docs)
    rows = list(enumerate(ODD_TEXTS)) + [(None, "the thing and that"), (3, "12 34 ?!"), (3, "12 34 ?!")]
    got = identify(documents(spark, rows), net).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    for i in (0, 1, 2, 10 - 10):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[3]["lang_pred"] in net.languages or by[3]["lang_pred"] == "und"
    assert by[None]["held_out"] is True or by[None]["held_out"] is False
    # the id, language and source of a row change nothing
    text = docs.select("text").limit(20).collect()
    first = identify(documents(spark, [(i, r["text"], "xx", "s") for i, r in enumerate(text)]), net).collect()
    second = identify(documents(spark, [(i + 777, r["text"]) for i, r in enumerate(text)]), net).collect()
    assert [(r["lang_pred"], r["score"]) for r in first] == [(r["lang_pred"], r["score"]) for r in second]


def test_whole_texts_count(spark, small):
    """A long text is judged by all of it, not by how it begins."""
    net = learn(spark.read.parquet(f"{small}/documents.parquet"))
    rows = {r["lang"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").filter("n_chars > 500").collect()}
    text = rows["fr"][:300] + " " + rows["en"] * 20
    assert identify(documents(spark, [(1, text)]), net).first()["lang_pred"] == "en"


def test_nothing_to_learn(spark):
    none = documents(spark, [(1, "some text"), (2, None)])
    assert learn(none) is None
    assert [r["lang_pred"] for r in identify(none, None).collect()] == ["und", "und"]
    one = documents(spark, [(1, "some text", "en"), (2, "", "fr")])
    assert [r["lang_pred"] for r in identify(one, learn(one)).orderBy("doc_id").collect()] == ["en", "und"]
    assert identify(documents(spark, []), None).collect() == []


def test_sample_is_bounded_if_ids_repeat_or_are_null(spark, monkeypatch):
    monkeypatch.setattr(language, "train", lambda windows, labels, languages: (len(windows), set(labels.tolist())))
    rows = [(None if i % 2 else 5, f"text number {i}", "ab"[i % 3 == 0]) for i in range(200)]
    assert learn(documents(spark, rows), rows=20) == (20, {0, 1})


def test_features_equal_a_plain_convolution():
    text = np.frombuffer(("plain words and bytes " * 30).encode(), np.uint8)
    windows, _, length = cut(text, np.array([0, len(text)]))
    assert len(windows) == -(-len(text) // WINDOW) and length.sum() == len(text)
    net = train(windows, np.arange(len(windows)) % 2, ["a", "b"])
    got, _ = net.features(windows)
    for f in range(0, len(net.bias), 7):
        taps = [t[:, f] for t in net.taps if t.shape[1] > f]
        for w, window in enumerate(windows):
            places = range(WINDOW - len(net.taps) + 1)
            best = max(sum(t[window[k + j]] for j, t in enumerate(taps)) for k in places)
            assert np.isclose(got[w, f], max(best + net.bias[f], 0), atol=1e-4)
