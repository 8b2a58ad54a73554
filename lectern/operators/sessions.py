"""Tutoring sessions replayed from an action log.

Log columns: ``session``, ``ts``, ``id`` (unique), ``action`` (upload, explain, next, prev,
analogy, example, quiz) and ``response``, the text the action would produce.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.text import or_empty
from lectern.operators.ordered import FAR, Clamp, Last, Ordered, Sum, ordered, running

GROUP, ORDER = ["session"], ["ts", "id"]
# A chunk is a stretch of time of one session; lower it for sessions with more rows than that
# a task should hold.
CHUNK_SECONDS = 30 * 86_400
FOLLOW_UPS = ("analogy", "example", "quiz")


def _is(*actions: str) -> Column:
    return F.col("action").isin(*actions)


def _log(log: DataFrame, chunk_seconds: int) -> Ordered:
    """Sessions in chunks of so many seconds, so that one of any length is spread over tasks."""
    return ordered(log, GROUP, ORDER, F.floor(F.unix_seconds("ts") / chunk_seconds))


def _segment() -> Sum:
    return Sum(F.when(_is("upload"), 1).otherwise(0).cast("long"))


def _seen() -> Last:
    """The latest explanation ahead of a row; an upload clears it."""
    return Last(F.when(_is("upload"), "").when(_is("explain"), or_empty("response")), before=True)


def _slide_idx(total: Column | int) -> Clamp:
    total = F.lit(total) if isinstance(total, int) else total
    shift = F.when(_is("next"), 1).when(_is("prev"), -1).otherwise(0)
    top = F.greatest(total - 1, F.lit(0))
    # An upload goes back to the first slide.
    return Clamp(shift, F.lit(0), F.when(_is("upload"), 0).otherwise(top))


def _entry() -> Clamp:
    """Entries since the last upload."""
    return Clamp(F.when(_is(*fixed.ACTION_LABELS), 1).otherwise(0), F.lit(0), F.when(_is("upload"), 0).otherwise(FAR))


def _gated(rows: Ordered) -> DataFrame:
    """``last_explanation`` and ``message``, for rows with ``segment`` and ``_seen``; what was
    explained without a deck doesn't count."""
    without = F.col("segment") == F.when(_is("upload"), 1).otherwise(0)
    df = rows.df.withColumn("last_explanation", F.when(without, "").otherwise(or_empty("_seen")))
    message = F.when(_is("explain") & (F.col("segment") == 0), fixed.UPLOAD_FIRST).when(
        _is(*FOLLOW_UPS) & (F.col("last_explanation") == ""), fixed.EXPLAIN_FIRST
    )
    return df.withColumn("message", message).drop("chunk", "_seen")


def deck_segments(log: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """``segment``: uploads of the session so far; every upload starts a new one."""
    return running(_log(log, chunk_seconds), segment=_segment()).df.drop("chunk")


def last_explanation(log: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """The latest explanation ahead of each row in its segment, "" when there is none."""
    return gate_actions(log, chunk_seconds).drop("message")


def gate_actions(log: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """``message``: what to do first, for actions whose condition is not met; else null."""
    return _gated(running(_log(log, chunk_seconds), segment=_segment(), _seen=_seen()))


def navigate(log: DataFrame, total: Column | int, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """``slide_idx`` after each action, kept within the deck of ``total`` slides (a column
    of the log, when decks differ)."""
    count = F.lit(total) if isinstance(total, int) else total
    narrow = log.select("session", "ts", "id", "action", count.alias("_total"))
    rows = running(_log(narrow, chunk_seconds), slide_idx=_slide_idx(F.col("_total")))
    return rows.df.select("session", "ts", "id", "slide_idx")


def replay(log: DataFrame, total: Column | int, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Segment, slide index, last explanation and gate message of every action."""
    rows = _log(log, chunk_seconds)
    return _gated(running(rows, segment=_segment(), _seen=_seen(), slide_idx=_slide_idx(total)))


def chat_history(log: DataFrame, total: Column | int, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """The (label, reply) entries of each segment, numbered in order.

    Entries stay rows, since a session may be of any length.
    """
    rows = _log(log, chunk_seconds)
    placed = _gated(
        running(rows, segment=_segment(), _seen=_seen(), slide_idx=_slide_idx(total), entry=_entry())
    )
    label = F.when(F.lit(False), "")
    for action, text in fixed.ACTION_LABELS.items():
        label = label.when(_is(action), text)
    explained = _is("explain") & F.col("message").isNull()
    slides = F.concat(F.lit(" slides ["), F.col("slide_idx").cast("string"), F.lit("]"))
    return placed.filter(_is(*fixed.ACTION_LABELS)).select(
        "session",
        "segment",
        F.col("entry").cast("long").alias("entry"),
        F.concat(label, F.when(explained, slides).otherwise("")).alias("label"),
        F.coalesce("message", or_empty("response")).alias("reply"),
    )
