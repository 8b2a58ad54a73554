"""Column functions over texts and parallel lists; all of them stay in Catalyst."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import fixed


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def or_empty(col: Column | str) -> Column:
    return F.coalesce(_col(col), F.lit(""))


def clean_text(col: Column | str) -> Column:
    """Null becomes "", white space of any kind is stripped at both ends."""
    return F.btrim(or_empty(col), F.lit(fixed.WHITESPACE))


def or_default(col: Column, default: str) -> Column:
    """``default`` for null and for the empty text."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def best_answer(texts: Column | str, scores: Column | str) -> Column:
    """The text with the highest score, the first one on ties.

    Lists of different length, or without scores, give the first text; no texts give "".
    """
    texts, scores = _col(texts), _col(scores)
    at_best = F.get(texts, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))
    paired = (F.size(scores) > 0) & (F.size(scores) == F.size(texts))
    return or_empty(F.when(paired, at_best).otherwise(F.get(texts, F.lit(0))))


def lookup_choice(labels: Column | str, texts: Column | str, key: Column | str) -> Column:
    """The text beside ``key``; the last of repeated labels counts, no match gives ""."""
    labels, texts, key = _col(labels), _col(texts), _col(key)
    at = F.array_max(
        F.transform(labels, lambda label, i: F.when((label == key) & (i < F.size(texts)), i))
    )
    return or_empty(F.get(texts, at))


def is_deck(path: Column | str) -> Column:
    """Whether a path ends in ``.pptx``, in any case."""
    return F.lower(_col(path)).endswith(".pptx")


def preview(col: Column | str, n: int, empty: str) -> Column:
    """The first ``n`` characters, with "..." when there are more."""
    text = clean_text(col)
    return (
        F.when(F.length(text) == 0, F.lit(empty))
        .when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("...")))
        .otherwise(text)
    )


def truncate_at_stop(col: Column | str, stops: list[str]) -> Column:
    """Cut at the first stop, in list order, that occurs in the text; then strip."""
    text = or_empty(col)
    cut = None
    for stop in stops:
        at = F.instr(text, F.lit(stop))
        head = F.left(text, at - 1)
        cut = F.when(at > 0, head) if cut is None else cut.when(at > 0, head)
    return clean_text(text if cut is None else cut.otherwise(text))


def topic_of(col: Column | str) -> Column:
    """A short topic from a slide text: all of it up to 50 characters, else the first
    sentence when its stop is the 2nd to 100th character, else 100 characters."""
    text = clean_text(col)
    dot = F.instr(text, F.lit("."))
    return (
        F.when(F.length(text) == 0, F.lit(fixed.TOPIC_WHEN_BLANK))
        .when(F.length(text) <= 50, text)
        .when(dot.between(2, 100), F.left(text, dot))
        .otherwise(F.left(text, F.lit(100)))
    )


def concept_topic(text: Column | str, topic: Column | str | None = None) -> Column:
    """The given topic, else the text before its first "."."""
    first = clean_text(F.substring_index(or_empty(text), ".", 1))
    found = or_default(first, fixed.CONCEPT_WHEN_BLANK)
    if topic is None:
        return found
    return F.coalesce(F.nullif(_col(topic), F.lit("")), found)


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template with ``{name}`` placeholders as one concatenation, so that a value
    which happens to contain a placeholder is left alone."""
    pieces: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            pieces.append(or_empty(values[name].cast("string")))
    return F.concat(*pieces)


def occurrences(col: Column, piece: str) -> Column:
    """How often ``piece`` occurs, without overlaps."""
    removed = F.length(col) - F.length(F.replace(col, F.lit(piece), F.lit("")))
    return (removed / len(piece)).cast("int")
