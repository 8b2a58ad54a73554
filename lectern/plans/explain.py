"""Decks to explanations and derived material, with a caller's generator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.text import or_empty
from lectern.operators.context import (
    deck_topic,
    in_context,
    render_prompts,
    select_slides,
    slide_context,
    style_prompts,
    with_concept_topic,
)
from lectern.operators.hooks import Captioner, Generator, caption_images, generate
from lectern.operators.quiz import check_quiz

# Tokens and temperature by kind of request.
MAX_TOKENS = {"explanation": 512, "analogy": 256, "example": 384, "quiz": 768}
TEMPERATURE = 0.7
QUIZ_TEMPERATURE = 0.4


def deck_requests(
    decks: DataFrame,
    slides: DataFrame,
    indices: list[int] | None = None,
    captioned: DataFrame | None = None,
) -> DataFrame:
    """Per deck: ``topic``, ``text`` (the slide context), ``slides_used`` and
    ``slides_in_context``; ``topic`` is null for decks without slides.

    Context and topic are grouped by deck from filtered slides, so their join needs no
    further shuffle.
    """
    selected = select_slides(slides, indices)
    context = slide_context(selected, captioned)
    topic = deck_topic(slides, indices)
    held = F.coalesce("slides_in_context", F.lit(0)).cast("int")
    first = F.when(held > 0, F.sequence(F.lit(0), held - 1))
    used = first if indices is None else F.array(*[F.lit(i) for i in indices])
    return (
        decks.select("deck")
        .join(topic, "deck", "left")
        .join(context, "deck", "left")
        .select(
            "deck",
            "topic",
            F.when(F.col("topic").isNotNull(), or_empty("slide_context")).alias("text"),
            F.coalesce(used, F.array().cast("array<int>")).alias("slides_used"),
            held.alias("slides_in_context"),
        )
    )


def _result(df: DataFrame, what: str, *extra: str, on_failure: Column | None = None) -> DataFrame:
    """``on_failure`` is the topic of a row that failed; "" without it."""
    failed = F.col("error").isNotNull()
    fallback = F.lit("") if on_failure is None else on_failure
    return df.select(
        *extra,
        or_empty("generated").alias(what),
        F.when(failed, fallback).otherwise(or_empty("topic")).alias("topic"),
        "error",
    )


def _given(topic: str | Column | None) -> Column:
    """The caller's topic; "" when there is none."""
    return F.lit("") if topic is None else or_empty(topic)


def _settings(**values: float | int) -> Column:
    """The settings of a request that went well; null for one that failed."""
    settings = F.struct(*[F.lit(v).alias(name) for name, v in values.items()])
    return F.when(F.col("error").isNull(), settings)


def explain_batch(
    decks: DataFrame,
    slides: DataFrame,
    make_generator: Callable[[], Generator],
    indices: list[int] | None = None,
    images: DataFrame | None = None,
    make_captioner: Callable[[], Captioner] | None = None,
    style: str = "comprehensive",
    temperature: float = TEMPERATURE,
    max_tokens: int = MAX_TOKENS["explanation"],
    tasks: int | None = None,
    blobs: DataFrame | None = None,
    memo: str | None = None,
) -> DataFrame:
    """One result row per deck: explanation, topic, slides used, settings, error.

    A deck without slides and a failing generation give a row with ``error``. With ``blobs``
    the captioner gets the bytes of the pictures. With ``memo``, captions are kept there by
    the pictures' ``sha1`` and not asked for again.
    """
    captioned = None
    if images is not None and make_captioner is not None:
        key = "sha1" if memo else "image_path"
        captioned = caption_images(
            images.filter(in_context(indices)), make_captioner, blobs=blobs, memo=memo, key=key
        )
    requests = deck_requests(decks, slides, indices, captioned)
    prompted = style_prompts(requests, style)
    sent = prompted.withColumn("messages", F.when(F.col("topic").isNotNull(), F.col("messages")))
    done = generate(sent, make_generator, max_tokens, temperature, spread_by=["deck"], tasks=tasks)
    asked = F.array(*[F.lit(i) for i in indices or []]).cast("array<int>")
    done = done.withColumn(
        "error", F.when(F.col("topic").isNull(), fixed.NO_SLIDES_ERROR).otherwise(F.col("error"))
    ).withColumn(
        "slides_used", F.when(F.col("error").isNull(), F.col("slides_used")).otherwise(asked)
    )
    metadata = F.struct(
        F.lit(temperature).alias("temperature"),
        F.lit(max_tokens).alias("max_tokens"),
        F.lit(captioned is not None).alias("include_images"),
        F.col("style").alias("style"),
    )
    return _result(
        done.withColumn("metadata", metadata),
        "explanation",
        "deck",
        "slides_used",
        "slides_in_context",
        "metadata",
    )


def derive_material(
    df: DataFrame,
    kind: str,
    make_generator: Callable[[], Generator],
    text: str = "text",
    topic: str | None = None,
    temperature: float = TEMPERATURE,
    max_tokens: int | None = None,
    keep: tuple[str, ...] = ("key",),
    tasks: int | None = None,
) -> DataFrame:
    """Analogies or examples from earlier text, with their topic and ``metadata``; failures
    carry ``error``, the caller's topic ("" without one) and no metadata.

    ``keep`` names the columns that identify a row."""
    df = df.withColumn("_given", _given(topic))
    prompted = render_prompts(with_concept_topic(df, text, topic), kind, "topic", text)
    tokens = max_tokens or MAX_TOKENS[kind]
    done = generate(prompted, make_generator, tokens, temperature, spread_by=keep, tasks=tasks)
    done = done.withColumn("metadata", _settings(temperature=temperature, max_tokens=tokens))
    what = {"analogy": "analogies", "example": "examples"}[kind]
    return _result(done, what, *keep, "metadata", on_failure=F.col("_given"))


def make_quizzes(
    df: DataFrame,
    make_generator: Callable[[], Generator],
    text: str = "text",
    topic: str | Column | None = None,
    num_questions: int = 3,
    keep: tuple[str, ...] = ("key",),
    tasks: int | None = None,
) -> DataFrame:
    """Checked quizzes on a text: ``items`` or ``error``, the ``raw`` output, the topic and
    ``metadata``; failures carry the caller's topic ("" without one) and no metadata."""
    df = df.withColumn("_given", _given(topic))
    prompted = render_prompts(
        with_concept_topic(df, text, topic), "quiz", "topic", text, num_questions
    )
    done = generate(
        prompted, make_generator, MAX_TOKENS["quiz"], QUIZ_TEMPERATURE, spread_by=keep, tasks=tasks
    )
    made = done.select(
        *keep, "_given", "topic", F.col("generated").alias("raw"), F.col("error").alias("_e")
    )
    checked = check_quiz(made, "raw", num_questions)
    checked = checked.withColumn("error", F.coalesce("_e", "error"))
    metadata = _settings(num_questions=num_questions, temperature=QUIZ_TEMPERATURE)
    shown = F.when(F.col("error").isNull(), F.col("topic")).otherwise(F.col("_given"))
    return checked.withColumn("topic", shown).withColumn("metadata", metadata).drop("_e", "_given")
