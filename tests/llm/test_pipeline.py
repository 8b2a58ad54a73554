import pytest

import corpus_pipeline
from lectern.llm import personal
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, FOLDER), "test")
        out[name] = docs
    return out


def test_each_stage(spark, stages):
    columns = stages["documents"].columns
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = {r["doc_id"] for r in stages["quality"].collect()}
    assert all(labels[i] for i in good & labels.keys())
    assert {i for i, q in labels.items() if q} <= good

    rows = [(r["doc_id"], r["text"]) for r in stages["quality"].collect()]
    groups = {c for _, c in brute.components(rows)}
    assert {r["doc_id"] for r in stages["near_copies"].collect()} == groups

    assert not any(personal.plain(r["text"]) for r in stages["personal_data"].collect())
    assert stages["personal_data"].count() == stages["near_copies"].count()

    words = lambda rows: sum(len(r["text"].encode().split()) for r in rows.collect())
    assert abs(words(stages["mix"]) - words(stages["personal_data"])) <= 2 * 20
    kept = {r["doc_id"] for r in stages["mix"].collect()}
    assert {r["doc_id"] for r in stages["sequences"].select("doc_id").collect()} == kept


def test_run(spark, stages):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == stages["sequences"].columns
    assert out.agg({"length": "sum"}).first()[0] == stages["sequences"].agg({"length": "sum"}).first()[0]
