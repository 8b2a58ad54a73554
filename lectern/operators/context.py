"""Slide selection, context strings, topics and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed, prompts
from lectern.functions.text import clean_text, concept_topic, fill, or_empty, topic_of
from lectern.operators.chat import message
from lectern.operators.skew import concat_ordered


def select_slides(
    slides: DataFrame, indices: list[int] | None = None, max_n: int = fixed.MAX_SLIDES
) -> DataFrame:
    """The chosen slides with their ``position``.

    Without indices these are the first ``max_n`` of each deck; else the first ``max_n`` of
    the list, in list order and with repeats, without those a deck does not have. Slide
    numbers are dense, so both are filters over the slides, with no shuffle.
    """
    index = F.col("slide_number") - 1
    if indices is None:
        return slides.filter(F.col("slide_number") <= max_n).withColumn("position", index)
    wanted = list(indices)[:max_n]
    at = {i: [p for p, v in enumerate(wanted) if v == i] for i in wanted if i >= 0}
    places = F.when(F.lit(False), F.array().cast("array<int>"))
    for i, positions in at.items():
        places = places.when(index == i, F.array(*[F.lit(p) for p in positions]))
    return slides.filter(index.isin(list(at))).withColumn("position", F.explode(places))


def in_context(indices: list[int] | None = None, max_n: int = fixed.MAX_SLIDES) -> Column:
    """Whether a ``slide_number`` is among the chosen slides."""
    if indices is None:
        return F.col("slide_number") <= max_n
    return (F.col("slide_number") - 1).isin(list(indices)[:max_n])


def _table_lines(table: Column) -> Column:
    row = lambda r: F.array_join(F.transform(r, or_empty), " | ")
    lines = F.transform(
        table,
        lambda r, i: F.concat(F.when(i == 0, "Tables: | ").otherwise("| "), row(r), F.lit(" |")),
    )
    return lines


def slide_block(captions: Column | None = None) -> Column:
    """The context lines of one slide: header, text, tables, notes, image lines."""
    text = clean_text("text_content")
    none = F.array().cast("array<string>")
    tables = F.coalesce(F.flatten(F.transform("tables", _table_lines)), none)
    head = F.array(
        F.concat(F.lit("--- Slide "), F.col("slide_number").cast("string"), F.lit(" ---")),
        F.when(F.length(text) > 0, F.concat(F.lit("Text: "), text)),
    )
    tail = F.array(
        F.when(F.length("notes") > 0, F.concat(F.lit("Speaker Notes: "), F.col("notes"))),
        captions if captions is not None else F.lit(None).cast("string"),
    )
    return F.array_join(F.concat(F.array_compact(head), tables, F.array_compact(tail)), "\n")


def image_lines(captioned: DataFrame) -> DataFrame:
    """The "Image: ..." lines per slide, from captioned images."""
    lines = captioned.filter(F.length("image_path") > 0).withColumn(
        "line", F.concat(F.lit("Image: "), or_empty("caption"))
    )
    return concat_ordered(lines, ["deck", "slide_number"], "ordinal", "line", "\n", "image_lines")


def slide_context(selected: DataFrame, captioned: DataFrame | None = None) -> DataFrame:
    """``slide_context`` per deck from selected slides (at most a handful per deck)."""
    captions = None
    if captioned is not None:
        selected = selected.join(image_lines(captioned), ["deck", "slide_number"], "left")
        captions = F.col("image_lines")
    blocks = selected.select("deck", "position", slide_block(captions).alias("block"))
    joined = F.expr("listagg(block, '\\n\\n') WITHIN GROUP (ORDER BY position)")
    return blocks.groupBy("deck").agg(
        clean_text(joined).alias("slide_context"),
        F.count("*").alias("slides_in_context"),
    )


def deck_topic(slides: DataFrame, indices: list[int] | None = None) -> DataFrame:
    """``topic`` per deck from the first chosen slide, its index clamped to the deck.

    The clamped slide is the last one not beyond the index, found by a map-side maximum.
    """
    first = max(0, (indices or [0])[0])
    return (
        slides.filter(F.col("slide_number") <= first + 1)
        .select("deck", "slide_number", topic_of("text_content").alias("topic"))
        .groupBy("deck")
        .agg(F.max_by("topic", "slide_number").alias("topic"))
    )


def with_concept_topic(df: DataFrame, text: str = "text", topic: str | None = None) -> DataFrame:
    return df.withColumn("topic", concept_topic(text, topic))


def prompt_messages(
    template: str | Column, topic: str, text: str, num_questions: int = 3, note: Column | None = None
) -> Column:
    """System and user message for a generation request."""
    values = {
        "topic": F.col(topic),
        "text": F.col(text),
        "num_questions": F.lit(num_questions),
    }
    user = fill(template, values) if isinstance(template, str) else template
    if note is not None:
        user = F.concat(user, note)
    return F.array(message("system", F.lit(fixed.SYSTEM_TEXT)), message("user", user))


def render_prompts(
    df: DataFrame,
    kind: str,
    topic: str = "topic",
    text: str = "text",
    num_questions: int = 3,
    templates: dict[str, str] | None = None,
) -> DataFrame:
    """``messages`` for one kind: explanation, analogy, example, step_by_step or quiz."""
    template = (templates or prompts.KINDS)[kind]
    return df.withColumn("messages", prompt_messages(template, topic, text, num_questions))


def style_prompts(
    df: DataFrame, style: str | Column, topic: str = "topic", text: str = "text"
) -> DataFrame:
    """``messages`` and the reported ``style``, per row when ``style`` is a column.

    step_by_step has its own prompt; eli5 and feynman add a note to the explanation prompt;
    anything else is comprehensive.
    """
    key = F.lower(F.coalesce(F.lit(style) if isinstance(style, str) else style, F.lit("")))
    values = {"topic": F.col(topic), "text": F.col(text)}
    user = F.when(key == "step_by_step", fill(prompts.STEPS, values))
    for name, note in prompts.STYLE_NOTES.items():
        user = user.when(key == name, fill(prompts.EXPLANATION + note, values))
    user = user.otherwise(fill(prompts.EXPLANATION, values))
    reported = F.when(key.isin(*fixed.STYLES), key).otherwise(F.lit("comprehensive"))
    return df.withColumn("style", reported).withColumn(
        "messages", prompt_messages(user, topic, text)
    )


def all_styles(df: DataFrame, topic: str = "topic", text: str = "text") -> DataFrame:
    """Every row in every style."""
    styled = df.withColumn("_style", F.explode(F.array(*[F.lit(s) for s in fixed.STYLES])))
    return style_prompts(styled, F.col("_style"), topic, text).drop("_style")


def chat_text(messages: Column | str = "messages", generation_header: bool = False) -> Column:
    """Messages as one ChatML prompt, optionally opened for the assistant's turn."""
    turns = F.transform(
        messages,
        lambda m: F.concat(
            F.lit("<|im_start|>"),
            or_empty(m["role"]),
            F.lit("\n"),
            or_empty(m["content"]),
            F.lit("<|im_end|>\n"),
        ),
    )
    text = F.array_join(turns, "")
    return F.concat(text, F.lit("<|im_start|>assistant\n")) if generation_header else text


def render_chat(df: DataFrame, generation_header: bool = False) -> DataFrame:
    return df.withColumn("prompt", chat_text("messages", generation_header))
