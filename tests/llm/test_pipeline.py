import pytest
from llm.cases import ODD_TEXTS, documents, prose, words

import corpus_pipeline
from waveplan.llm import mixing, neardup, pii, quality
from waveplan.llm.catalog import ORACLES, QUERIES


def test_stages_are_those_of_the_contract():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "mixing", "packing"]
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    assert ORACLES.keys() <= QUERIES.keys()


def test_each_stage_does_what_its_operator_says(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, small)
    kept = {r["doc_id"] for r in quality.judge_quality(docs, labels).filter("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept
    first = corpus_pipeline.near_duplicates(spark, good, small)
    classes = neardup.near_duplicates(good).collect()
    assert sorted(r["doc_id"] for r in first.collect()) == sorted({r["class_id"] for r in classes})
    clean = corpus_pipeline.personal_data(spark, first, small)
    assert clean.schema == first.schema and clean.count() == first.count()
    assert pii.find(clean, None).filter("size(filter(base, x -> x.kind IN ('email', 'ip', 'phone'))) > 0").isEmpty()
    mixed = corpus_pipeline.mix(spark, clean, small)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(clean).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies
    packed = corpus_pipeline.pack(spark, mixed, small).collect()
    assert sum(r["length"] for r in packed) == sum(len(words(r["text"])) + 1 for r in mixed.collect())


def test_run_writes_each_stage(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "piece", "start", "length", "bucket", "batch_cell", "batch", "slot"]
    assert out.count() > 0


@pytest.mark.parametrize("rows", [[], [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, None), (5, prose(80, 1)), (5, prose(80, 1))]])
def test_odd_rows_pass_every_stage(spark, small, rows):
    docs = documents(spark, rows)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, small)
        assert out.schema == docs.schema
        assert out.count() <= max(len(rows) * 3, 0)
    assert corpus_pipeline.pack(spark, docs, small).count() == len(rows)
    assert corpus_pipeline.quality_rules(spark, docs, small).schema == docs.schema
