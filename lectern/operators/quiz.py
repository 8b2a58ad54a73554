"""Quizzes from generated text. A quiz is one row with its items nested."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.frames import once
from lectern.functions.json import has_key, is_list, read_json, whole_json
from lectern.functions.text import or_empty


def _fenced_list(raw: Column) -> Column:
    """From the first "[" after a json fence to the last "]" of the text, else null."""
    fence = F.instr(raw, F.lit(fixed.QUIZ_FENCE))
    start = F.locate("[", F.substring(raw, fence, F.length(raw))) + fence - 1
    # The last "]" is the first one from the end.
    end = F.length(raw) - F.instr(F.reverse(raw), F.lit("]")) + 1
    found = (fence > 0) & (start >= fence) & (end > start) & raw.contains("]")
    return F.when(found, F.substring(raw, start, end - start + 1))


def parse_quiz(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``parsed``: the items of the list in the text, texts as they are and other values as
    JSON; null when there is no list. ``_list`` is the list itself.

    The whole text is tried first; only when it is no JSON at all, the fenced list.
    """
    text = F.col(raw)
    found = once(df, _json=F.coalesce(whole_json(text), whole_json(_fenced_list(text))))
    listed = found.withColumn("_list", F.when(is_list(F.col("_json")), F.col("_json"))).drop("_json")
    return once(listed, parsed=read_json(F.col("_list"), "array<string>"))


def _complete(keys: Column) -> Column:
    """Whether an item is an object with the four keys; their values may be null."""
    return reduce(and_, [has_key(keys, key) for key in fixed.QUIZ_KEYS])


# An item as it is read; of repeated keys the last one counts.
_ITEMS = "array<struct<question:string, options:array<string>, correct_index:string, rationale:string>>"


def _item(item: Column) -> Column:
    index = item["correct_index"].try_cast("double").try_cast("int")
    return item.withField("correct_index", index)


def check_quiz(df: DataFrame, raw: str = "raw", num_questions: int = 3) -> DataFrame:
    """``items`` of good quizzes, or the ``error`` of bad ones; ``count_differs`` flags a
    good quiz with another number of questions than asked for."""
    # Null unless all items are objects.
    objects = read_json(F.col("_list"), "array<map<string,string>>")
    found = once(parse_quiz(df, raw), _keys=F.transform(objects, lambda o: F.map_keys(o)))
    good = F.coalesce(F.forall("_keys", _complete), F.lit(False))
    error = F.when(F.col("parsed").isNull(), fixed.QUIZ_NOT_A_LIST).when(~good, fixed.QUIZ_BAD_ITEM)
    judged = once(found, error=error)
    good = F.when(F.col("error").isNull(), F.col("_list"))
    items = F.transform(read_json(good, _ITEMS), _item)
    read = once(judged, items=items).drop("parsed", "_list", "_keys")
    differs = F.size("items") != num_questions if num_questions else F.lit(False)
    return read.withColumn("count_differs", differs)


def answer_of(item: Column) -> Column:
    """The option at ``correct_index``; null when there is none."""
    return F.get(item["options"], item["correct_index"])


def quiz_rows(checked: DataFrame, *keep: str) -> DataFrame:
    """One row per question of the good quizzes, numbered from 1."""
    rows = checked.select(*keep, F.posexplode("items").alias("pos", "item"))
    return rows.select(
        *keep,
        (F.col("pos") + 1).alias("number"),
        F.col("item.question").alias("question"),
        F.col("item.options").alias("options"),
        answer_of(F.col("item")).alias("answer"),
        F.col("item.rationale").alias("rationale"),
    )


def _question_markdown(item: Column, i: Column) -> Column:
    options = F.transform(item["options"], lambda o: F.concat(F.lit("- "), or_empty(o)))
    return F.concat(
        F.lit("**Q"),
        (i + 1).cast("string"),
        F.lit(": "),
        or_empty(item["question"]),
        F.lit("**\n"),
        or_empty(F.array_join(options, "\n")),
        F.lit("\n**Answer:** "),
        or_empty(answer_of(item)),
        F.lit("\n**Rationale:** "),
        or_empty(item["rationale"]),
        F.lit("\n"),
    )


def quiz_markdown(checked: DataFrame, raw: str = "raw") -> DataFrame:
    """``markdown``: the questions with a blank line between, or a note on a bad quiz."""
    good = F.array_join(F.transform("items", _question_markdown), "\n\n")
    bad = F.concat(
        F.lit("Received unexpected format for questions: "),
        F.col("error"),
        F.lit(": "),
        or_empty(raw),
    )
    return checked.withColumn("markdown", F.when(F.col("error").isNull(), good).otherwise(bad))


def quiz_rejects(checked: DataFrame, *keep: str, raw: str = "raw") -> DataFrame:
    return checked.filter(F.col("error").isNotNull()).select(*keep, "error", raw)
