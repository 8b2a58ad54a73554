import pytest
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.operators import chat
from tests.conftest import chat_rows, told

QA = "key string, corpus string, question string, answer string, context string, support string, fact string"


def test_user_turns_by_corpus(spark):
    rows = [("1", c, "Q", "A", "C", "S", "F") for c in ("ELI5", "sciq", "OpenBookQA", "wikihow", "other")]
    turns = [r["user_turn"] for r in chat.render_user_turn(spark.createDataFrame(rows, QA)).collect()]
    assert turns[0].startswith("Question: Q\n\nContext: C\n\nProvide a clear")
    assert turns[1].startswith("Science Question: Q\n\nSupporting information: S\n\n")
    assert turns[2].startswith("Question: Q\n\nRelevant fact: F\n\n")
    assert turns[3] == "Question: Q\n\nProvide a step-by-step explanation."
    assert turns[4] == "Question: Q"


def test_build_messages(spark):
    df = spark.createDataFrame([("1", "other", "Q", " A ", None, None, None)], QA)
    with_system = told(chat.build_messages(df).first())
    assert [r for r, _ in with_system] == ["system", "user", "assistant"]
    assert with_system[0][1] == fixed.SYSTEM_TEXT and with_system[2][1] == "A"
    assert told(chat.build_messages(df, with_system=False).first()) == with_system[1:]
    assert chat.build_messages(df.limit(0)).count() == 0


def test_suffix_on_every_user_turn(spark):
    df = chat_rows(spark, [[("user", "a"), ("assistant", "b"), ("user", "c"), (None, None)]])
    got = told(chat.append_to_user_turns(df, "+", 5).first())
    assert got == [("user", "a+"), ("assistant", "b"), ("user", "c+"), ("user", "")]


@pytest.mark.parametrize("n, left", [(0, 0), (2, 2), (99, 3)])
def test_augmentation_size(spark, n, left):
    df = chat_rows(spark, [[("user", "a")], [("user", "b")], [("user", "c")]])
    assert chat.augment_steps(df, n).count() == left
    assert chat.augment_analogy(df.limit(0), n).count() == 0


def test_augmentations_differ_in_their_sample(spark):
    df = chat_rows(spark, [[("user", str(i))] for i in range(50)])
    samples = [
        {r["key"] for r in augment(df, 10).collect()}
        for augment in (chat.augment_analogy, chat.augment_examples, chat.augment_steps)
    ]
    assert all(len(s) == 10 for s in samples) and len({frozenset(s) for s in samples}) == 3


def test_only_the_first_assistant_is_replaced(spark):
    df = chat_rows(
        spark,
        [[("user", "a"), ("assistant", "b"), ("assistant", "c")], [("user", "a")], [(None, "a")]],
    )
    got = [told(r) for r in chat.replace_first_assistant(df, F.lit("new")).orderBy("key").collect()]
    assert got == [
        [("user", "a"), ("assistant", "new"), ("assistant", "c")],
        [("user", "a")],
        [("user", "a")],
    ]


FAULTS = [
    None,
    [("user", "a"), ("assistant", "b")],
    [("tool", "a"), ("assistant", None)],
    [("user", ""), (None, "b")],
    [],
    [None, ("user", "a"), ("assistant", "b")],
]


def test_one_row_per_violation(spark):
    got = {}
    for r in chat.validate_chat(chat_rows(spark, FAULTS)).collect():
        got.setdefault(r["key"], []).append(r["violation"])
    assert got == {
        "0": [fixed.NO_MESSAGES],
        "2": [fixed.BAD_ROLE, fixed.NO_CONTENT, fixed.NO_USER],
        "3": [fixed.BAD_ROLE, fixed.NO_CONTENT, fixed.NO_ASSISTANT],
        "4": [fixed.NO_USER, fixed.NO_ASSISTANT],
    }


def test_validity(spark):
    bad = chat.validity(chat_rows(spark, FAULTS)).first()
    assert not bad["valid"] and bad["errors"] == 9 and bad["missing_user_message"] == 2
    good = chat.validity(chat_rows(spark, FAULTS[1:2])).first()
    assert good["valid"] and good["errors"] == 0
    empty = chat.validity(chat_rows(spark, [])).first()
    assert empty["valid"] and empty["errors"] == 0


def test_length_stats(spark):
    df = chat_rows(spark, [[("user", "ab"), ("user", "😀"), ("assistant", "xyz")], None, [("system", "s")]])
    row = chat.length_stats(df).first()
    assert (row["total"], row["avg_user_len"], row["avg_assistant_len"]) == (3, 1.5, 3.0)
    none = chat.length_stats(df.limit(0)).first()
    assert (none["total"], none["avg_user_len"]) == (0, 0.0)
    by_key = chat.length_stats(df, "key").orderBy("key").collect()
    assert [r["avg_assistant_len"] for r in by_key] == [3.0, 0.0, 0.0]


def test_augmentation_stats(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "kind string")
    got = {r["kind"]: r["records"] for r in chat.augmentation_stats(df).collect()}
    assert got == {"a": 2, "b": 1, "combined_augmented": 3}
