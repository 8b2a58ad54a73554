"""Random inputs against plain Python."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.json import whole_json
from lectern.functions.text import best_answer, clean_text, lookup_choice, topic_of, truncate_at_stop
from lectern.operators import quiz

FEW = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
SPACE = st.sampled_from(list(fixed.WHITESPACE))
TEXT = st.text(st.one_of(SPACE, st.sampled_from("ab.😀é")), max_size=160)


def evaluate(spark, schema, rows, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


@FEW
@given(texts=st.lists(TEXT, min_size=1, max_size=60))
def test_strip_and_topic(spark, texts):
    rows = [(t,) for t in texts]
    assert evaluate(spark, "t string", rows, clean_text("t")) == [t.strip() for t in texts]

    def topic(text):
        text = text.strip()
        if len(text) <= 50:
            return text or fixed.TOPIC_WHEN_BLANK
        dot = text.find(".")
        return text[: dot + 1] if 0 < dot < 100 else text[:100]

    assert evaluate(spark, "t string", rows, topic_of("t")) == [topic(t) for t in texts]


@FEW
@given(texts=st.lists(st.text("abc ", max_size=12), min_size=1, max_size=60), stops=st.lists(st.text("abc", min_size=1, max_size=3), max_size=3))
def test_stops(spark, texts, stops):
    def cut(text):
        present = [s for s in stops if s in text]
        return (text[: text.index(present[0])] if present else text).strip()

    got = evaluate(spark, "t string", [(t,) for t in texts], truncate_at_stop("t", stops))
    assert got == [cut(t) for t in texts]


LABELS = st.lists(st.sampled_from("ABC"), max_size=5)
WORDS = st.lists(st.text("xyz", max_size=2), max_size=5)


@FEW
@given(rows=st.lists(st.tuples(LABELS, WORDS, st.sampled_from("ABCD"), st.lists(st.integers(0, 3), max_size=5)), min_size=1, max_size=60))
def test_choices_and_answers(spark, rows):
    schema = "l array<string>, t array<string>, k string, s array<int>"
    found = evaluate(spark, schema, rows, lookup_choice("l", "t", "k"))
    assert found == [dict(zip(labels, texts)).get(k, "") for labels, texts, k, _ in rows]

    def best(texts, scores):
        if texts and scores and len(texts) == len(scores):
            return texts[scores.index(max(scores))]
        return texts[0] if texts else ""

    assert evaluate(spark, schema, rows, best_answer("t", "s")) == [best(t, s) for _, t, _, s in rows]


VALUE = st.recursive(
    st.none() | st.booleans() | st.integers(-99, 99) | st.text("a\"\\é[]{}", max_size=4),
    lambda v: st.lists(v, max_size=3) | st.dictionaries(st.sampled_from("abc"), v, max_size=2),
    max_leaves=6,
)
SNIPPET = st.builds(
    lambda value, junk, cut: (json.dumps(value) + junk)[cut:],
    VALUE,
    st.sampled_from(["", "", "", " ", "]", "}", ",", ", 1", "],[1", '},{"a":1', "x"]),
    st.sampled_from([0, 0, 0, 1]),
)


def loads(text):
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


@FEW
@given(texts=st.lists(SNIPPET, min_size=1, max_size=80))
def test_json(spark, texts):
    got = evaluate(spark, "t string", [(t,) for t in texts], whole_json(F.col("t")))
    for text, parsed in zip(texts, got):
        valid, value = loads(text)
        assert (parsed is not None) == valid, text
        assert not valid or json.loads(parsed) == value, text


KEYS = list(fixed.QUIZ_KEYS)
ITEM = st.fixed_dictionaries({}, optional={k: st.sampled_from(["x", 1, None, ["a", "b"]]) for k in KEYS})
FULL = st.fixed_dictionaries({k: st.sampled_from(["x", 1, None, ["a", "b"]]) for k in KEYS})
RAW = st.builds(
    lambda before, value, after: before + json.dumps(value) + after,
    st.sampled_from(["", "", "text\n```json\n", "[1] ```json ", "```\n", "]```json["]),
    st.lists(FULL | FULL | ITEM | st.just(3), max_size=3) | FULL,
    st.sampled_from(["", "", "\n```", "``` [see]", "]"]),
)


@FEW
@given(raws=st.lists(RAW, min_size=1, max_size=80))
def test_quizzes(spark, raws):
    def judge(raw):
        valid, value = loads(raw)
        fence = raw.find("```json")
        if not valid and fence >= 0:
            start, end = raw.find("[", fence), raw.rfind("]")
            if 0 <= start < end:
                value = loads(raw[start : end + 1])[1]
        if not isinstance(value, list):
            return fixed.QUIZ_NOT_A_LIST
        whole = all(isinstance(i, dict) and set(KEYS) <= set(i) for i in value)
        return None if whole else fixed.QUIZ_BAD_ITEM

    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = [r["error"] for r in quiz.check_quiz(df).orderBy("i").collect()]
    assert got == [judge(r) for r in raws]
