import json

import pytest

from lectern.functions import fixed
from lectern.operators import evaluate, quiz

ITEM = {"question": "Q?", "options": ["a", "b", "c"], "correct_index": 1, "rationale": "R"}
LIST = json.dumps([ITEM])


def check(spark, raw, n=1):
    return quiz.check_quiz(spark.createDataFrame([(raw,)], "raw string"), num_questions=n)


@pytest.mark.parametrize(
    "raw, error, items",
    [
        (LIST, None, 1),
        ("[]", None, 0),
        (f"Sure [1]:\n```json\n{LIST}\n```\nDone.", None, 1),
        (f"```json\n{LIST}\n``` see [2]", fixed.QUIZ_NOT_A_LIST, None),
        (f"text {LIST}", fixed.QUIZ_NOT_A_LIST, None),
        (f"```\n{LIST}\n```", fixed.QUIZ_NOT_A_LIST, None),
        ("not json", fixed.QUIZ_NOT_A_LIST, None),
        (json.dumps(ITEM), fixed.QUIZ_NOT_A_LIST, None),
        ("```json ] [", fixed.QUIZ_NOT_A_LIST, None),
        (None, fixed.QUIZ_NOT_A_LIST, None),
        (json.dumps([ITEM, {"question": "x"}]), fixed.QUIZ_BAD_ITEM, None),
        (json.dumps([ITEM, 3]), fixed.QUIZ_BAD_ITEM, None),
        (json.dumps([{**ITEM, "rationale": None}]), None, 1),
    ],
)
def test_parse_and_check(spark, raw, error, items):
    row = check(spark, raw).first()
    assert row["error"] == error
    assert (row["items"] is None) if items is None else (len(row["items"]) == items)


def test_count_is_only_flagged(spark):
    assert check(spark, LIST, 1).first()["count_differs"] is False
    assert check(spark, LIST, 3).first()["count_differs"] is True


def test_rows_and_answers(spark):
    raw = json.dumps([ITEM, {**ITEM, "correct_index": 9}, {**ITEM, "options": None}])
    rows = quiz.quiz_rows(check(spark, raw)).orderBy("number").collect()
    assert [(r["number"], r["answer"]) for r in rows] == [(1, "b"), (2, None), (3, None)]


def test_markdown(spark):
    raw = json.dumps([ITEM, {**ITEM, "correct_index": 9, "options": []}])
    text = quiz.quiz_markdown(check(spark, raw)).first()["markdown"]
    assert text == (
        "**Q1: Q?**\n- a\n- b\n- c\n**Answer:** b\n**Rationale:** R\n\n\n"
        "**Q2: Q?**\n\n**Answer:** \n**Rationale:** R\n"
    )
    bad = quiz.quiz_markdown(check(spark, "nope")).first()["markdown"]
    assert bad.startswith("Received unexpected format") and bad.endswith("nope")
    assert quiz.quiz_rejects(check(spark, "nope")).first()["raw"] == "nope"
    assert quiz.quiz_rejects(check(spark, LIST)).count() == 0


def test_quality(spark):
    def score(items):
        row = evaluate.quiz_quality(check(spark, json.dumps(items))).first()
        return row["count"], row["has_rationales"], row["options_plausible"]

    assert score([ITEM]) == (1, True, True)
    assert score([]) == (0, True, True)
    assert score([ITEM, {**ITEM, "rationale": ""}]) == (2, False, True)
    assert score([{**ITEM, "options": ["a", "b"]}]) == (1, True, False)
