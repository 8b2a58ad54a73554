import json

from lectern.functions import fixed
from lectern.plans import prepare
from lectern.sources import jsonl, qa
from tests.conftest import told


def read_json(path):
    (part,) = path.glob("part-*")
    return json.loads(part.read_text())


def sources(spark, n=25):
    pairs = spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(n)], "key int, query string, passage string")
    return {c: qa.qa_from_pairs(pairs, c) for c in fixed.CORPORA}


def test_prepare_then_augment(spark, tmp_path):
    out = tmp_path / "processed"
    prepare.run_prepare(sources(spark), str(out))
    stats = read_json(out / "dataset_stats.json")
    assert stats["combined"] == {"train": {"count": 95}, "val": {"count": 5}}
    assert [stats[c]["total"] for c in fixed.CORPORA] == [25] * 4
    splits = jsonl.read_chat_splits(spark, str(out / "combined_train.jsonl"), str(out / "combined_val.jsonl"))
    everything = sorted(tuple(told(r)) for df in splits.values() for r in df.collect())
    per_corpus = [
        tuple(told(r))
        for c in fixed.CORPORA
        for r in jsonl.read_chat_jsonl(spark, str(out / f"{c}_instructions.jsonl")).records.collect()
    ]
    assert everything == sorted(per_corpus) and len(everything) == 100

    sizes = prepare.sizes_from({"analogies": 10, "examples": 1000, "step_by_step": 0, "other": 1})
    more = tmp_path / "augmented"
    prepare.run_augment(spark, str(out / "combined_train.jsonl"), str(more), sizes)
    assert read_json(more / "augmentation_stats.json") == {
        "original": 95,
        "analogies": 10,
        "examples": 95,
        "step_by_step": 0,
        "back_translated": 0,
        "combined_augmented": 200,
    }
    assert spark.read.text(str(more / "combined_augmented.jsonl")).count() == 200
    examples = jsonl.read_chat_jsonl(spark, str(more / "with_examples.jsonl")).records.collect()
    assert all(told(r)[1][1].endswith(fixed.EXAMPLES_REQUEST) for r in examples) and len(examples) == 95
    for name in ("step_by_step", "back_translated"):
        assert spark.read.text(str(more / f"{name}.jsonl")).count() == 0


def test_limit_per_corpus(spark, tmp_path):
    prepare.run_prepare(sources(spark), str(tmp_path), n=5)
    assert read_json(tmp_path / "dataset_stats.json")["combined"]["train"]["count"] == 19


def test_empty_corpora(spark, tmp_path):
    none = {c: df.limit(0) for c, df in sources(spark).items()}
    prepare.run_prepare(none, str(tmp_path))
    assert spark.read.text(str(tmp_path / "combined_train.jsonl")).count() == 0


def test_a_sample_is_fixed_by_its_seed(spark, tmp_path):
    """However the lines are laid out, and with equal lines among them."""
    lines = [json.dumps({"messages": [{"role": "user", "content": f"q{i % 40}"}, {"role": "assistant", "content": "a"}], "id": i % 40}) for i in range(60)]
    rows = spark.createDataFrame([(line,) for line in lines], "value string")
    got = []
    for i, layout in enumerate((rows.coalesce(1), rows.repartition(7), rows.orderBy("value"))):
        path = tmp_path / f"train{i}.jsonl"
        layout.write.text(str(path))
        prepare.run_augment(spark, str(path), str(tmp_path / f"out{i}"), {"analogies": 20, "examples": 5, "step_by_step": 60})
        out = [
            sorted(r["value"] for r in spark.read.text(str(tmp_path / f"out{i}" / file)).collect())
            for file in ("with_analogies.jsonl", "with_examples.jsonl", "step_by_step.jsonl", "combined_augmented.jsonl")
        ]
        assert [len(o) for o in out] == [20, 5, 60, 145]
        assert set(lines) <= set(out[3])
        got.append(out)
        assert sorted(p.name for p in (tmp_path / f"out{i}").iterdir() if p.is_dir()) == sorted(
            [*prepare.FILES.values(), "augmentation_stats.json", "combined_augmented.jsonl"]
        )
    assert got[0] == got[1] == got[2]
