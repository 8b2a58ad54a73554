import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lectern.operators.sampling import concat_sets
from lectern.sources import jsonl, qa
from tests.conftest import chat_rows, told


def rows(df, *names):
    return [tuple(r) for r in df.orderBy("key").select(*names).collect()]


def test_scored_answers(spark):
    schema = "key int, title string, selftext string, answers struct<text:array<string>,score:array<int>>"
    df = spark.createDataFrame(
        [
            (1, " Why? ", "ctx ", (["low", " high "], [1, 9])),
            (2, "No answer", "", ([], [])),
            (3, None, "", (["a"], [1])),
            (4, "Null context", None, (["a"], [1])),
        ],
        schema,
    )
    got = rows(qa.qa_from_scored_answers(df), "corpus", "question", "context", "answer")
    assert got == [("eli5", "Why?", "ctx", "high"), ("eli5", "Null context", "", "a")]


def test_pairs_and_flat(spark):
    pairs = spark.createDataFrame([(1, " q ", "a\n"), (2, "q", " ")], "key int, query string, passage string")
    assert rows(qa.qa_from_pairs(pairs, "eli5"), "question", "answer", "context") == [("q", "a", "")]
    assert rows(qa.qa_from_pairs(pairs), "corpus", "context") == [("wikihow", None)]
    flat = spark.createDataFrame([(1, "t", None, "a"), (2, "t", "s", None)], "key int, title string, selftext string, answer string")
    assert rows(qa.qa_from_flat(flat), "question", "context", "answer") == [("t", "", "a")]


def test_distractors_are_kept_as_they_are(spark):
    df = spark.createDataFrame(
        [(1, "q", "c", " s ", " x ", None, "z")],
        "key int, question string, correct_answer string, support string, "
        "distractor1 string, distractor2 string, distractor3 string",
    )
    got = rows(qa.qa_from_distractors(df), "question", "answer", "support", "distractors")
    assert got == [("q", "c", "s", [" x ", "", "z"])]


def test_keyed_choices(spark):
    df = spark.createDataFrame(
        [
            (1, "Fish live in?", "fact ", (["A", "B"], ["Water", "Sand"]), " A "),
            (2, "No match", "", (["A"], ["x"]), "C"),
        ],
        "key int, question_stem string, fact1 string, "
        "choices struct<label:array<string>,text:array<string>>, answerKey string",
    )
    got = rows(qa.qa_from_keyed_choices(df), "question", "answer", "fact", "all_choices")
    assert got == [("Fish live in?", "Water", "fact", ["Water", "Sand"])]


def test_articles(spark):
    df = spark.createDataFrame(
        [
            (1, " Bake ", "short", "long"),
            (2, None, "", "long"),
            (3, "", None, " long "),
            (4, "t", " ", "long"),
        ],
        "key int, title string, summary string, article_text string",
    )
    assert rows(qa.qa_from_articles(df), "question", "answer") == [
        ("Explain how to Bake", "short"),
        ("Explain how to How to do it", "long"),
        ("Explain how to How to do it", "long"),
    ]


def test_head_comes_after_the_filter(spark):
    df = spark.createDataFrame([(i, "q" if i % 2 else "", "a") for i in range(100)], "key int, query string, passage string")
    answered = qa.qa_from_pairs(df).withColumn("n", F.col("key").cast("int"))
    assert [r["n"] for r in qa.head_n(answered, 3, "n").collect()] == [1, 3, 5]
    assert qa.head_n(answered, None).count() == 50
    assert qa.head_n(answered, 1000, "n").count() == 50


@pytest.mark.parametrize("n", [1, 49, 50, 51, 399, 400, 999])
def test_large_heads_are_exact(spark, n):
    df = spark.range(400).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("o"))
    got = {r["o"] for r in qa.head_n(df, n, "o").collect()}
    assert got == set(sorted(r["o"] for r in df.collect())[:n])


def test_tolerant_read(spark, tmp_path):
    lines = [
        '{"messages": [{"role": "user", "content": "é"}, {"role": "assistant", "content": "b", "x": 1}]}',
        "",
        "not json",
        '{"text": "no messages"}',
        "   ",
        "[1, 2]",
        '{"messages": null}',
        '{"messages": "text"}',
        '  {"messages": [{"content": 5}, null]}  ',
        '{"messages": []} trailing',
    ]
    path = tmp_path / "chat.jsonl"
    path.write_text("\n".join(lines), encoding="utf-8")
    read = jsonl.read_chat_jsonl(spark, str(path))
    kept = [r["messages"] for r in read.records.collect()]
    assert len(kept) == 4
    assert told({"messages": kept[0]}) == [("user", "é"), ("assistant", "b")]
    assert kept[1] is None and kept[2] is None
    assert kept[3][0]["role"] is None and kept[3][0]["content"] == "5"
    counts = {r["reason"]: r["lines"] for r in jsonl.reject_counts(read.rejects).collect()}
    assert counts == {jsonl.BAD_JSON: 2, jsonl.NO_MESSAGES_KEY: 1, jsonl.NOT_AN_OBJECT: 1}


def test_lines_of_any_length_and_all_their_fields(spark, tmp_path):
    big = "x" * 30_000_000
    lines = [
        '{"id": 7, "messages": [{"role": "user", "content": "' + big + '", "name": "n"}], "score": NaN}',
        '{"messages": [], "messages": [{"role": "user", "role": "tool", "content": "b"}], "id": -Infinity}',
        "{'messages': []}",
    ]
    (tmp_path / "big.jsonl").write_text("\n".join(lines), encoding="utf-8")
    read = jsonl.read_chat_jsonl(spark, str(tmp_path / "big.jsonl"))
    assert [r["reason"] for r in read.rejects.collect()] == [jsonl.BAD_JSON]
    kept = sorted(read.records.collect(), key=lambda r: -len(r["record"]))
    assert [told(r) for r in kept] == [[("user", big)], [("tool", "b")]]
    jsonl.write_chat_jsonl(read.records, str(tmp_path / "again.jsonl"))
    written = [r["value"] for r in spark.read.text(str(tmp_path / "again.jsonl")).collect()]
    assert sorted(written) == sorted(lines[:2])
    splits = jsonl.read_chat_splits(spark, str(tmp_path / "again.jsonl"), str(tmp_path / "again.jsonl"))
    assert sorted(r["record"] for r in splits["train"].collect()) == sorted(lines[:2])


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        jsonl.read_chat_jsonl(spark, str(tmp_path / "none.jsonl"))
    with pytest.raises(AnalysisException):
        jsonl.read_chat_splits(spark, str(tmp_path / "none"), str(tmp_path / "none"))


def test_write_and_strict_read(spark, tmp_path):
    records = chat_rows(spark, [[("user", "ü\n\"q\""), ("assistant", None)], [("user", "b")]])
    train, val = str(tmp_path / "train.jsonl"), str(tmp_path / "val.jsonl")
    jsonl.write_chat_jsonl(records, train, {"n": 2, "name": "ü"})
    jsonl.write_chat_jsonl(records.limit(1), val)
    text = sorted(r["value"] for r in spark.read.text(train).collect())
    assert '"content":null' in text[1] and "ü" in text[1]
    assert spark.read.text(str(tmp_path / "train.meta.json")).first()["value"] == '{"n": 2, "name": "ü"}'
    splits = jsonl.read_chat_splits(spark, train, val)
    assert sorted(map(told, splits["train"].collect())) == sorted(map(told, records.collect()))
    assert splits["validation"].count() == 1


def test_strict_read_wants_messages(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x"}\n')
    (tmp_path / "b.jsonl").write_text('{"messages": [{"role": "user", "content": "x"}]}\n')
    with pytest.raises(ValueError, match="lacks a 'messages' column"):
        jsonl.read_chat_splits(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl"))


def test_strict_read_fails_on_a_broken_line(spark, tmp_path):
    good = '{"messages": [{"role": "user", "content": "x"}]}\n'
    (tmp_path / "a.jsonl").write_text(good + "broken\n")
    (tmp_path / "b.jsonl").write_text(good)
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        splits = jsonl.read_chat_splits(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl"))
        splits["train"].collect()


def test_union_keeps_duplicates(spark):
    df = spark.range(3)
    assert concat_sets(df, df, df).count() == 9
