import pytest
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.json import has_key, is_object, keys, read_json, whole_json
from lectern.functions.text import (
    best_answer,
    clean_text,
    concept_topic,
    fill,
    is_deck,
    lookup_choice,
    occurrences,
    preview,
    topic_of,
    truncate_at_stop,
)


def evaluate(spark, schema, rows, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_clean_text_strips_every_kind_of_white_space(spark):
    rows = [("\t\n a b \xa0　",), (None,), ("\x1c\x85x ",), ("",), ("  ",)]
    assert evaluate(spark, "t string", rows, clean_text("t")) == ["a b", "", "x", "", ""]


def test_white_space_is_what_python_strips():
    everything = {chr(c) for c in range(0x110000) if chr(c).isspace()}
    assert set(fixed.WHITESPACE) == everything


@pytest.mark.parametrize(
    "texts, scores, best",
    [
        (["a", "b", "c"], [1, 3, 3], "b"),
        (["a", "b"], [], "a"),
        (["a", "b"], [5], "a"),
        (["a", "b"], None, "a"),
        ([], [], ""),
        ([], [1], ""),
        (None, None, ""),
    ],
)
def test_best_answer(spark, texts, scores, best):
    schema = "t array<string>, s array<int>"
    assert evaluate(spark, schema, [(texts, scores)], best_answer("t", "s")) == [best]


@pytest.mark.parametrize(
    "labels, texts, key, found",
    [
        (["A", "B"], ["x", "y"], "B", "y"),
        (["A", "B", "A"], ["x", "y", "z"], "A", "z"),
        (["A", "B", "A"], ["x", "y"], "A", "x"),
        (["A"], ["x", "y"], "B", ""),
        (["A"], [], "A", ""),
        (None, None, "A", ""),
    ],
)
def test_lookup_choice(spark, labels, texts, key, found):
    schema = "l array<string>, t array<string>, k string"
    rows = [(labels, texts, key)]
    assert evaluate(spark, schema, rows, lookup_choice("l", "t", "k")) == [found]


def test_only_pptx_in_any_case(spark):
    rows = [("a.pptx",), ("b.PPTX",), ("c.ppt",), ("pptx",)]
    assert evaluate(spark, "p string", rows, is_deck("p")) == [True, True, False, False]


def test_preview(spark):
    rows = [("x" * 5,), ("x" * 6,), ("  ",), (None,)]
    got = evaluate(spark, "t string", rows, preview("t", 5, "-"))
    assert got == ["xxxxx", "xxxxx...", "-", "-"]


@pytest.mark.parametrize(
    "text, stops, cut",
    [
        ("xaxb", ["b", "a"], "xax"),
        ("hello END world", ["END", "STOP"], "hello"),
        ("a STOP b END", ["END", "STOP"], "a STOP b"),
        (" plain ", ["END"], "plain"),
        (" plain ", [], "plain"),
    ],
)
def test_truncate_at_stop(spark, text, stops, cut):
    assert evaluate(spark, "t string", [(text,)], truncate_at_stop("t", stops)) == [cut]


def test_topic(spark):
    long = "x" * 120
    cases = {
        "": fixed.TOPIC_WHEN_BLANK,
        " \n": fixed.TOPIC_WHEN_BLANK,
        "y" * 50: "y" * 50,
        "y" * 51: "y" * 51,
        "Short. " + long: "Short.",
        "." + long: "." + long[:99],
        "z" * 99 + "." + long: "z" * 99 + ".",
        "z" * 100 + "." + long: "z" * 100,
    }
    got = evaluate(spark, "t string", [(t,) for t in cases], topic_of("t"))
    assert got == list(cases.values())


def test_concept_topic(spark):
    rows = [(" One. Two", None), ("One. Two", "given"), (".x", ""), (None, None)]
    got = evaluate(spark, "t string, g string", rows, concept_topic("t", "g"))
    assert got == ["One", "given", "Concept", "Concept"]


def test_fill_leaves_placeholders_in_values_alone(spark):
    column = fill("{a} {{b}} {b}!", {"a": F.col("a"), "b": F.col("b")})
    assert evaluate(spark, "a string, b string", [("{b}", None)], column) == ["{b} {b} !"]


def test_occurrences_do_not_overlap(spark):
    rows = [("\n\n\n",), ("\n\n\n\n",), ("a",)]
    assert evaluate(spark, "t string", rows, occurrences(F.col("t"), "\n\n")) == [1, 2, 0]


@pytest.mark.parametrize(
    "text, valid",
    [
        ('{"a": 1}', True),
        ("[1, 2]", True),
        ('"x"', True),
        ("null", True),
        ('{"a": 1} more', False),
        ('{"a": 1}}', False),
        ("[1] ]", False),
        ("1, 2", False),
        ("1],[2", False),
        ('{"a": 1},', False),
        ("", False),
        ("{a: 1}", False),
    ],
)
def test_whole_json_accepts_one_value_only(spark, text, valid):
    got = evaluate(spark, "t string", [(text,)], whole_json(F.col("t")).isNotNull())
    assert got == [valid]


def test_the_last_of_repeated_keys_counts(spark):
    value = read_json(F.col("t"), "a string")["a"]
    assert evaluate(spark, "t string", [('{"a": 1, "a": 2}',)], value) == ["2"]


def test_keys_may_hold_null(spark):
    rows = [('{"messages": null}',), ('{"m": 1}',), ("[1]",), ("3",)]
    held = has_key(keys(F.col("t")), "messages")
    assert evaluate(spark, "t string", rows, held) == [True, False, False, False]
    assert evaluate(spark, "t string", rows, is_object(F.col("t"))) == [True, True, False, False]
