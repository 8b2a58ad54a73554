import pytest
from pyspark.sql import functions as F

from lectern.functions import fixed, prompts
from lectern.operators import context
from tests.conftest import chat_rows, told

SLIDES = "deck string, slide_number int, text_content string, tables array<array<array<string>>>, notes string"


def deck(spark, n=4, name="d"):
    rows = [(name, i, f"text {i}", [], None) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, SLIDES)


def chosen(df):
    return [r["slide_number"] - 1 for r in df.orderBy("position").collect()]


@pytest.mark.parametrize(
    "n, indices, want",
    [
        (10, None, [0, 1, 2, 3, 4]),
        (3, None, [0, 1, 2]),
        (4, [7, 0, 0, -1, 1, 2], [0, 0, 1]),
        (4, [3, 1], [3, 1]),
        (4, [], []),
    ],
)
def test_select_slides(spark, n, indices, want):
    assert chosen(context.select_slides(deck(spark, n), indices)) == want


def test_selection_needs_no_shuffle(spark):
    plan = context.select_slides(deck(spark), [2, 0])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_context_layout(spark):
    slides = spark.createDataFrame(
        [
            ("d", 1, " Intro ", [[["h1", "h2"], ["a", None]], []], "note"),
            ("d", 2, "", None, ""),
            ("d", 3, "End", [], None),
        ],
        SLIDES,
    )
    captioned = spark.createDataFrame(
        [("d", 1, 1, "p2", "cap2"), ("d", 1, 0, "p1", "cap1"), ("d", 3, 0, "", "skipped")],
        "deck string, slide_number int, ordinal int, image_path string, caption string",
    )
    row = context.slide_context(context.select_slides(slides), captioned).first()
    assert row["slides_in_context"] == 3
    assert row["slide_context"] == (
        "--- Slide 1 ---\nText: Intro\nTables: | h1 | h2 |\n| a |  |\nSpeaker Notes: note\n"
        "Image: cap1\nImage: cap2\n\n--- Slide 2 ---\n\n--- Slide 3 ---\nText: End"
    )


def test_deck_topic_clamps_the_first_index(spark):
    slides = deck(spark, 3).unionByName(deck(spark, 1, "e"))

    def topics(indices):
        return {r["deck"]: r["topic"] for r in context.deck_topic(slides, indices).collect()}

    assert topics(None) == {"d": "text 1", "e": "text 1"}
    assert topics([9, 0]) == {"d": "text 3", "e": "text 1"}
    assert topics([-4]) == {"d": "text 1", "e": "text 1"}
    assert topics([]) == {"d": "text 1", "e": "text 1"}


def test_prompts(spark):
    df = spark.createDataFrame([("T", "body {topic}")], "topic string, text string")
    for kind in prompts.KINDS:
        (system, user) = told(context.render_prompts(df, kind, num_questions=4).first())
        assert system == ("system", fixed.SYSTEM_TEXT)
        assert user[0] == "user" and "Topic: T" in user[1] and "body {topic}" in user[1]
    assert "Write 4 multiple-choice" in told(context.render_prompts(df, "quiz", num_questions=4).first())[1][1]


@pytest.mark.parametrize(
    "style, reported",
    [("ELI5", "eli5"), ("step_by_step", "step_by_step"), ("haiku", "comprehensive"), (None, "comprehensive")],
)
def test_styles(spark, style, reported):
    df = spark.createDataFrame([("T", "body", style)], "topic string, text string, s string")
    row = context.style_prompts(df, F.col("s")).first()
    user = told(row)[1][1]
    assert row["style"] == reported
    assert user.endswith(prompts.STYLE_NOTES.get(reported, ".\n"))


def test_all_styles(spark):
    df = spark.createDataFrame([("T", "body")], "topic string, text string")
    assert [r["style"] for r in context.all_styles(df).collect()] == list(fixed.STYLES)


def test_render_chat(spark):
    df = chat_rows(spark, [[("user", "hi"), ("assistant", None)]])
    assert context.render_chat(df, True).first()["prompt"] == (
        "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>assistant\n"
    )
