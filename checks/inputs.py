"""Inputs of the operators, derived from the given tables (whole tables, whole texts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLIDES = 12
CORPORA = ("eli5", "sciq", "openbookqa", "wikihow", "other")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(number: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (number % len(names) + 1).cast("int"))


def chat(spark: SparkSession, folder: str) -> DataFrame:
    """``key, conv_id, messages``."""
    turns = table(spark, folder, "conversations")
    listed = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t")
    )
    messages = F.transform(
        "t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))
    )
    return listed.select(
        F.col("conv_id").cast("string").alias("key"), "conv_id", messages.alias("messages")
    )


def faulty_chat(spark: SparkSession, folder: str) -> DataFrame:
    """``chat`` with faults by conversation: no list, a bad role, an empty or absent text."""
    kind = F.col("conv_id") % 6

    def fault(m: Column, i: Column) -> Column:
        first = i == 0
        role = F.when(first & (kind == 1), "tool").when(first & (kind == 3), None)
        content = F.when(first & (kind == 2), "").when(first & (kind == 3), None)
        bad_role = first & kind.isin(1, 3)
        bad_content = first & kind.isin(2, 3)
        return F.struct(
            F.when(bad_role, role).otherwise(m["role"]).alias("role"),
            F.when(bad_content, content).otherwise(m["content"]).alias("content"),
        )

    faulty = F.when(kind != 0, F.transform("messages", fault))
    return chat(spark, folder).withColumn("messages", faulty)


def exchanges(spark: SparkSession, folder: str) -> DataFrame:
    """Each user turn with the assistant turn after it and the turn before it (or null).

    The joins are on (conversation, turn), which is unique.
    """
    turns = table(spark, folder, "conversations")
    after = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    before = turns.select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context")
    )
    return (
        turns.filter("role = 'user'")
        .select("conv_id", "turn", F.col("text").alias("question"))
        .join(after, ["conv_id", "turn"], "left")
        .join(before, ["conv_id", "turn"], "left")
        .withColumn("key", F.concat_ws("-", "conv_id", "turn"))
        .withColumn("corpus", pick(F.col("conv_id"), CORPORA))
    )


def _texts(role: str) -> Column:
    return F.transform(
        F.filter("messages", lambda m: m["role"] == role), lambda m: m["content"]
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """title, selftext and the assistant texts scored by length modulo 7; every fifth
    conversation lacks its last score."""
    texts = _texts("assistant")
    scores = F.transform(texts, lambda t: F.length(t) % 7)
    short = F.when(F.size(scores) > 0, F.slice(scores, 1, F.size(scores) - 1)).otherwise(scores)
    return chat(spark, folder).select(
        "key",
        F.get(_texts("user"), F.lit(0)).alias("title"),
        F.get(_texts("system"), F.lit(0)).alias("selftext"),
        F.struct(
            texts.alias("text"),
            F.when(F.col("conv_id") % 5 == 0, short).otherwise(scores).alias("score"),
        ).alias("answers"),
    )


def keyed(spark: SparkSession, folder: str) -> DataFrame:
    """A choice for each message, with a repeated label in every seventh conversation; the wanted
    key is that of any of them, or matches nothing."""

    def label(i: Column) -> Column:
        letter = F.char(F.lit(65) + i % 26)
        return F.when((F.col("conv_id") % 7 == 0) & (i == 2), "A").otherwise(
            F.concat(letter, F.when(i >= 26, F.floor(i / 26).cast("string")).otherwise(""))
        )

    labels = F.transform("messages", lambda m, i: label(i))
    texts = F.transform("messages", lambda m: m["content"])
    wanted = F.get(labels, (F.col("conv_id") % (F.size("messages") + 1)).cast("int"))
    return chat(spark, folder).select(
        "key",
        F.get(_texts("user"), F.lit(0)).alias("question_stem"),
        F.get(_texts("system"), F.lit(0)).alias("fact1"),
        F.struct(labels.alias("label"), texts.alias("text")).alias("choices"),
        F.concat(F.lit(" "), F.coalesce(wanted, F.lit("?"))).alias("answerKey"),
    )


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = exchanges(spark, folder)
    return rows.select("key", F.col("question").alias("query"), F.col("answer").alias("passage"))


def flat(spark: SparkSession, folder: str) -> DataFrame:
    rows = exchanges(spark, folder)
    return rows.select(
        "key", F.col("question").alias("title"), F.col("context").alias("selftext"), "answer"
    )


def distractors(spark: SparkSession, folder: str) -> DataFrame:
    return exchanges(spark, folder).select(
        "key",
        "question",
        F.col("answer").alias("correct_answer"),
        F.col("context").alias("support"),
        F.col("context").alias("distractor1"),
        F.lit(None).cast("string").alias("distractor2"),
        F.concat(F.lit(" "), "question").alias("distractor3"),
    )


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as articles; the summary or the title is missing in some."""
    docs = table(spark, folder, "documents")
    third = F.col("doc_id") % 3
    return docs.select(
        F.col("doc_id").cast("string").alias("key"),
        F.when(F.col("doc_id") % 4 != 0, F.concat_ws(" in ", "source", "lang")).alias("title"),
        F.when(third == 1, F.concat_ws(" ", "lang", "text")).when(third == 2, "").alias("summary"),
        F.col("text").alias("article_text"),
    )


def qa(spark: SparkSession, folder: str) -> DataFrame:
    """Exchanges of all corpora as wide QA rows, answered ones only."""
    return exchanges(spark, folder).filter(F.col("answer").isNotNull()).select(
        "key",
        "corpus",
        "question",
        "answer",
        "context",
        F.col("context").alias("support"),
        F.col("context").alias("fact"),
    )


def jsonl_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events as lines: a record, broken JSON, no messages, a list, blank."""
    role = F.when(F.col("event_type") == "error", "tool").otherwise("user")
    record = F.concat(
        F.lit('  {"id": '),
        F.col("event_id").cast("string"),
        F.lit(', "messages": [{"role": "'),
        role,
        F.lit('", "content": "'),
        F.col("event_type"),
        F.lit(' "}, {"role": "assistant", "content": "event '),
        F.col("event_id").cast("string"),
        F.lit('"}]}\t'),
    )
    value = (
        F.when(F.col("event_id") % 5 == 0, record)
        .when(F.col("event_id") % 5 == 1, F.concat(record, F.lit(" more")))
        .when(F.col("event_id") % 5 == 2, F.col("props"))
        .when(F.col("event_id") % 5 == 3, F.concat(F.lit("["), "props", F.lit("]")))
        .otherwise(F.lit(" \t "))
    )
    return table(spark, folder, "events").select("event_id", "ts", value.alias("value"))


def deck_name() -> Column:
    return F.concat(F.lit("deck"), F.floor(F.col("doc_id") / SLIDES).cast("string"))


def deck_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as slides, twelve to a deck: a line is a shape, and every second slide has
    a table."""
    shapes = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            F.concat(F.lit("line "), i.cast("string")).alias("shape_name"),
            F.lit("TEXT_BOX (17)").alias("shape_type"),
            F.array(F.split(line, " ")).alias("paragraphs"),
        ),
    )
    # Runs keep their blanks, as the words are joined without any.
    shapes = F.transform(
        shapes,
        lambda s: s.withField(
            "paragraphs",
            F.transform(
                s["paragraphs"],
                lambda p: F.transform(
                    p, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.lit(" "), w))
                ),
            ),
        ),
    )
    cells = F.array(
        F.array(F.col("source"), F.lit(None).cast("string")),
        F.array(F.col("lang"), F.col("n_chars").cast("string")),
    )
    none = F.array().cast("array<array<array<string>>>")
    return table(spark, folder, "documents").select(
        deck_name().alias("deck"),
        (F.col("doc_id") % SLIDES + 1).cast("int").alias("slide_number"),
        shapes.alias("shapes"),
        F.when(F.col("doc_id") % 2 == 0, F.array(cells)).otherwise(none).alias("tables"),
        F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("notes"),
    )


def slides(spark: SparkSession, folder: str) -> DataFrame:
    from lectern.operators.decks import finish_slides

    return finish_slides(deck_rows(spark, folder))


def deck_images(spark: SparkSession, folder: str) -> DataFrame:
    """Up to two images per slide; some have no path."""
    ordinal = F.explode(F.sequence(F.lit(0), F.lit(1))).alias("ordinal")
    path = F.concat(F.lit("img/"), F.md5("text"), F.lit("-"), F.col("ordinal").cast("string"))
    return (
        table(spark, folder, "documents")
        .select("doc_id", "text", ordinal)
        .filter(F.col("ordinal") < F.col("doc_id") % 3)
        .select(
            deck_name().alias("deck"),
            (F.col("doc_id") % SLIDES + 1).cast("int").alias("slide_number"),
            "ordinal",
            F.when(F.col("doc_id") % 7 == 0, "").otherwise(path).alias("image_path"),
        )
    )


def lang_images(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as images of one deck per language, with exact copies among them."""
    return table(spark, folder, "documents").select(
        F.col("lang").alias("deck"),
        (F.col("doc_id") + 1).cast("int").alias("slide_number"),
        F.lit(0).alias("ordinal"),
        F.col("source").alias("shape_name"),
        F.lit("png").alias("image_format"),
        F.col("text").cast("binary").alias("blob"),
    )


def quiz_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as generator output: list, fenced list, broken, object, lacking a key, empty."""
    text = F.regexp_replace("text", '["\\\\\\x00-\\x1f]', " ")
    tail = F.concat(
        F.lit('", "options": ["A. '),
        F.col("lang"),
        F.lit('", "B. '),
        F.col("source"),
        F.lit('", "C. both"'),
        F.when(F.col("doc_id") % 4 == 0, ', "D. none"').otherwise(""),
        F.lit('], "correct_index": '),
        (F.col("doc_id") % 5).cast("string"),
        F.when(F.col("doc_id") % 9 == 0, ', "rationale": null}').otherwise(
            F.concat(F.lit(', "rationale": "see '), "source", F.lit('"}'))
        ),
    )
    item = F.concat(F.lit('{"question": "'), text, tail)
    short = F.concat(F.lit('{"question": "'), F.col("lang"), F.lit('", "options": []}'))
    kind = F.col("doc_id") % 6
    after = F.when(F.col("source") == "src7", " [end]").otherwise("")
    raw = (
        F.when(kind == 0, F.concat(F.lit("["), item, F.lit(", "), item, F.lit("]")))
        .when(kind == 1, F.concat(F.lit("Here [it] is:\n```json\n["), item, F.lit("]\n```"), after))
        .when(kind == 2, F.concat(F.lit("["), item))
        .when(kind == 3, item)
        .when(kind == 4, F.concat(F.lit("["), item, F.lit(", "), short, F.lit("]")))
        .otherwise(F.lit("[]"))
    )
    return table(spark, folder, "documents").select("doc_id", "lang", "text", raw.alias("raw"))


def spaced_text() -> Column:
    """The text, with blank lines in every second document."""
    spaced = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return F.when(F.col("doc_id") % 2 == 0, spaced).otherwise(F.col("text"))


def outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as generated texts."""
    return table(spark, folder, "documents").select("doc_id", "lang", spaced_text().alias("text"))


def score_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Answers against their questions; in the last corpus both sides are equal."""
    rows = qa(spark, folder)
    hyp = F.when(F.col("corpus") == "other", F.col("question")).otherwise(F.col("answer"))
    return rows.select("key", "corpus", hyp.alias("hyp"), F.col("question").alias("ref"))


def session_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as the action log of tutoring sessions."""
    follow_up = pick(F.col("event_id"), ("analogy", "example", "quiz"))
    kind = F.col("event_type")
    action = (
        F.when(kind == "signup", "upload")
        .when(kind == "view", "explain")
        .when(kind == "click", "next")
        .when(kind == "error", "prev")
        .otherwise(follow_up)
    )
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("session"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("id"),
        action.alias("action"),
        F.col("props").alias("response"),
    )


def train_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as training records: an eval loss only for views."""
    loss = F.when(F.col("event_type") == "view", F.col("value") / 100)
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("step"), loss.alias("eval_loss")
    )


def topics(spark: SparkSession, folder: str) -> DataFrame:
    """Generated material per document: explanation, analogies, examples and a quiz."""
    from lectern.operators.quiz import check_quiz

    return check_quiz(quiz_raw(spark, folder)).select(
        F.col("lang").alias("domain"),
        F.concat(F.lit("topic "), F.col("doc_id").cast("string")).alias("topic"),
        spaced_text().alias("explanation"),
        F.split("text", "\n").alias("analogies"),
        F.array("text", F.lit("see above")).alias("examples"),
        "items",
    )
