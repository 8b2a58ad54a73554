import random
import zlib

import numpy as np
import pytest

from lectern.llm.quality import NAMES, curve, discriminant, good_documents, moments, quality, statistics


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + "."


def junk(rng, n):
    kind = rng.random()
    if kind < 0.4:
        return " ".join([rng.choice(["buy", "now", "win"])] * n)
    return " ".join(f"{w}!!" for w in prose(rng, n).upper().split())


@pytest.fixture(scope="module")
def labelled(spark, docs):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(20, 200)) if i % 3 else junk(rng, rng.randint(20, 200))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0, "x") for i, _ in rows], "doc_id long, quality int, toxic int, score string")
    return rows, labels


def test_held_out_accuracy(docs, labelled):
    rows, labels = labelled
    got = quality(docs(rows), labels).collect()
    assert len(got) == len(rows)
    out = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in out} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_labels_held_out_and_odd_rows_change_nothing(spark, docs, labelled):
    rows, labels = labelled
    extra = [(None, "x"), (2, None), (3, ""), (3, ""), (900, "word " * 50_000)]
    first = {r["doc_id"]: r["score"] for r in quality(docs(rows), labels).collect()}
    wrong = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    odd = spark.createDataFrame([(None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    again = quality(docs(rows + extra[:1] + extra[4:]), wrong.unionByName(odd)).collect()
    for r in again:
        if r["doc_id"] in first:
            assert r["score"] == pytest.approx(first[r["doc_id"]], abs=1e-9)
    assert quality(docs(extra), labels).count() == 5


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(1, "a"), (2, None)]
    assert [(r["score"], r["predicted"]) for r in quality(docs(rows), none).collect()] == [(0.5, 0)] * 2
    assert good_documents(docs(rows), none).count() == 2
    assert quality(docs([]), none).collect() == []


def test_stage_keeps_rows_and_columns(docs, labelled):
    rows, labels = labelled
    kept = good_documents(docs(rows), labels)
    assert kept.columns == docs([]).columns
    ids = {r["doc_id"] for r in kept.collect()}
    good = {i for i, _ in rows if i % 3}
    assert len(ids & good) >= 0.98 * len(good) and len(ids - good) <= 0.05 * len(rows)


def test_discriminant_against_densities(spark):
    rng = np.random.default_rng(0)
    stats = [rng.normal(c, 1 + c, size=(200, len(NAMES))) for c in (0, 1)]
    frame = spark.createDataFrame([(c, x.tolist()) for c in (0, 1) for x in stats[c]], "label int, stats array<double>")
    sums = moments(frame)
    model = discriminant(sums, 0.1, 1e-3)
    x = rng.normal(size=(5, len(NAMES)))
    logs = []
    for c in (0, 1):
        mean = stats[c].mean(axis=0)
        pooled = np.diag((np.var(stats[0], axis=0) + np.var(stats[1], axis=0)) / 2)
        cov = 0.9 * np.cov(stats[c].T, bias=True) + 0.1 * pooled + 1e-3 * np.eye(len(NAMES))
        d = x - mean
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(0.5))
    assert np.allclose(model.difference(x), np.arcsinh(logs[1] - logs[0]))


def test_statistics_of_nothing_and_much():
    assert len(statistics(None)) == len(statistics("")) == len(statistics("a" * 300_000)) == len(NAMES)
    assert np.isfinite([statistics(t) for t in (None, "", " ", "\n", "\u00e9", "a b" * 9)]).all()
    slope, shift = curve([(-3.0, 50, 0), (3.0, 50, 50)])
    assert slope > 0.5 and abs(shift) < 0.1
