import math
import random
from collections import Counter

import pytest

from lectern.operators import evaluate


@pytest.mark.parametrize(
    "text, flags",
    [
        ("x" * 199, (False, True, False)),
        ("x" * 200, (True, True, False)),
        ("x" * 2000, (True, True, False)),
        ("x" * 2001, (False, True, False)),
        ("a\n\nb\n\nc", (False, True, True)),
        ("a\n\n\nb", (False, True, False)),
        ("", (False, False, False)),
        (None, (False, False, False)),
    ],
)
def test_explanation_quality(spark, text, flags):
    row = evaluate.explanation_quality(spark.createDataFrame([(text,)], "explanation string")).first()
    assert (row["length_ok"], row["has_intro_or_summary"], row["has_structure"]) == flags


def test_analogies_and_examples(spark):
    schema = "analogies array<string>, examples array<string>"
    df = spark.createDataFrame(
        [(["It is LIKE a river", None], ["no"]), (["as if"], ["For Example, tea"]), ([], ["room 7"]), (None, ["x²"])],
        schema,
    )
    a = [(r["count"], r["has_everyday_language"]) for r in evaluate.analogy_quality(df).collect()]
    e = [r["concrete"] for r in evaluate.example_quality(df).collect()]
    assert a == [(2, True), (1, False), (0, False), (0, False)]
    assert e == [False, True, True, True]


def corpus_bleu(pairs):
    """Whitespace-token BLEU by the published definition."""
    logs, misses, hyp_len, ref_len = 0.0, 0, 0, 0
    for n in range(1, 5):
        matched = total = 0
        for hyp, ref in pairs:
            h, r = hyp.split(), ref.split()
            if n == 1:
                hyp_len, ref_len = hyp_len + len(h), ref_len + len(r)
            grams = Counter(tuple(h[i : i + n]) for i in range(len(h) - n + 1))
            other = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
            matched += sum((grams & other).values())
            total += sum(grams.values())
        if not total:
            return 0.0
        if n == 1 and not matched:
            return 0.0
        if not matched:
            misses += 1
        logs += math.log((matched or 0.5**misses) / total)
    brevity = 1.0 if hyp_len >= ref_len else math.exp(1 - ref_len / hyp_len)
    return 100 * brevity * math.exp(logs / 4)


def test_bleu_against_the_definition(spark):
    rng = random.Random(5)
    words = "the cat sat on a mat with its hat".split()
    rows = []
    for group in ("a", "b", "c"):
        for i in range(20):
            ref = [rng.choice(words) for _ in range(rng.randint(0, 30))]
            hyp = [w if rng.random() < 0.7 else rng.choice(words) for w in ref][: rng.randint(1, 30)]
            rows.append((f"{group}{i}", group, " ".join(hyp), " ".join(ref)))
    rows += [("s0", "same", "the cat sat on a mat", "the cat sat on a mat"), ("z0", "none", "", ""), ("d0", "differ", "a b c d e", "f g h i j")]
    rows += [("u0", "unigrams only", "a b c d e", "e d c b a")]
    df = spark.createDataFrame(rows, "key string, g string, hyp string, ref string")
    got = {r["g"]: r["bleu"] for r in evaluate.corpus_bleu(df, "hyp", "ref", "g").collect()}
    for group in got:
        want = corpus_bleu([(r[2], r[3]) for r in rows if r[1] == group])
        assert got[group] == pytest.approx(want), group
    assert got["same"] == pytest.approx(100) and got["none"] == 0 and got["differ"] == 0
    assert 0 < got["unigrams only"] < 100


def test_texts_are_not_shuffled(spark):
    df = spark.createDataFrame([("1", "a b", "a b")], "key string, hyp string, ref string")
    plan = evaluate.ngram_totals(df, "hyp", "ref", ["key"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" in plan[plan.index("Exchange") :]


def test_matches_against_counters():
    rng = random.Random(1)
    for _ in range(200):
        hyp, ref = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in "hr")
        want = []
        for n in range(1, 5):
            a, b = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (hyp, ref))
            want.append(sum((a & b).values()))
        assert evaluate._matches(hyp, ref) == want


def test_bleu_words(spark):
    df = spark.createDataFrame([('It\'s 3.5%, "ok"-\nay; A&amp;B 2-3.',)], "t string")
    assert df.select(evaluate.bleu_text("t").alias("t")).first()["t"].split() == (
        "It's 3.5 % , \" ok \" ay ; A & B 2 - 3 .".split()
    )


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_rouge_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [("", ""), ("a", ""), ("The CAT, sat!", "the cat sat")]
    for _ in range(60):
        pairs.append(tuple(" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 90))) for _ in "hr"))
    df = spark.createDataFrame([(str(i), h, r) for i, (h, r) in enumerate(pairs)], "k string, h string, r string")
    got = {r["k"]: r["rouge_l"] for r in evaluate.rouge_l(df, "h", "r", "k").collect()}
    for i, (h, r) in enumerate(pairs):
        a, b = h.lower().replace(",", "").replace("!", "").split(), r.lower().split()
        want = 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 0.0
        assert got[str(i)] == pytest.approx(want)
    mean = evaluate.rouge_l(df, "h", "r").first()["rouge_l"]
    assert mean == pytest.approx(sum(got.values()) / len(got))


LOGS = [("r", 1, 2.0, 0.1), ("r", 2, None, 0.2), ("r", 3, 1.0, 0.3), ("r", 4, 1.0, 0.4), ("s", 1, None, 0.5)]


def test_training_logs(spark):
    logs = spark.createDataFrame(LOGS, "run string, step int, eval_loss double, lr double")
    assert [tuple(r) for r in evaluate.last_eval(logs).collect()] == [("r", 4, 1.0, 0.4)]
    assert [tuple(r) for r in evaluate.best_checkpoint(logs).collect()] == [("r", 3, 1.0, 0.3)]
    got = {r["run"]: r["perplexity"] for r in evaluate.perplexity(logs, "eval_loss", "run").collect()}
    assert got["r"] == pytest.approx(math.exp(4 / 3)) and got["s"] is None


def test_report(spark, tmp_path):
    item = "struct<question:string,options:array<string>,correct_index:int,rationale:string>"
    df = spark.createDataFrame(
        [
            ("Math", "Sets", "x" * 600, ["like a bag"], ["no"], [("q", ["a", "b", "c"], 0, "r")]),
            ("Arts", "Ink", "", [], [], []),
            ("Math", "Maps", "y", None, ["1"], None),
        ],
        f"domain string, topic string, explanation string, analogies array<string>, examples array<string>, items array<{item}>",
    )
    scores = evaluate.topic_scores(df)
    assert scores.filter("topic = 'Sets'").first()["sample"] == "x" * 500
    report = {r["domain"]: r for r in evaluate.quality_report(scores).collect()}
    assert report["Math"]["topics"] == 2 and report["Math"]["length_ok"] == 0.5
    assert report["Math"]["has_everyday_language"] == 0.5 and report["Arts"]["options_plausible"] == 1.0
    evaluate.write_report(scores, str(tmp_path))
    parts = sorted((tmp_path / "report.md").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).split("\n")
    assert lines[:4] == ["# Validation Report", "", "## Arts", lines[3]]
    assert lines[3].startswith('- **Ink**: {"explanation_scores":{"length_ok":false') and lines[4] == ""
    assert lines[5] == "## Math" and lines[6].startswith("- **Maps**") and lines[7].startswith("- **Sets**")
    assert spark.read.text(str(tmp_path / "report.json")).count() == 3
