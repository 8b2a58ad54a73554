"""Question/answer sources: each reader maps one corpus layout to the wide QA row.

Input frames carry a ``key`` column with a unique row id. Rows without a question or
without an answer are dropped. Everything is a projection and a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.text import best_answer, clean_text, lookup_choice, or_default, or_empty
from lectern.operators.sampling import first_rows
from lectern.schemas import QA_ARRAYS, QA_COLUMNS


def prune(df: DataFrame, keep: list[str]) -> DataFrame:
    """Keep only the named columns that exist."""
    return df.select(*[name for name in df.columns if name in keep])


def require_non_empty(df: DataFrame, *names: str) -> DataFrame:
    """Rows in which every named text has at least one character."""
    for name in names or ("question", "answer"):
        df = df.filter(F.length(name) > 0)
    return df


def head_n(df: DataFrame, n: int | None, order: str = "key") -> DataFrame:
    """The first ``n`` rows in source order; ``None`` keeps all. ``order`` must be unique.

    The n-th key is found by counting, and rows up to it are a filter.
    """
    return df if n is None else first_rows(df, n, order)


def _qa(df: DataFrame, corpus: str | Column, **columns: Column) -> DataFrame:
    values = {"key": F.col("key"), **columns}
    values["corpus"] = F.lit(corpus) if isinstance(corpus, str) else corpus
    row = [
        values.get(
            name,
            F.lit(None).cast("array<string>" if name in QA_ARRAYS else "string"),
        ).alias(name)
        for name in QA_COLUMNS
    ]
    return require_non_empty(df.select(*row), "question", "answer")


def qa_from_scored_answers(df: DataFrame, corpus: str = "eli5") -> DataFrame:
    """title, selftext, answers{text, score}: the answer with the best score."""
    return _qa(
        df,
        corpus,
        question=clean_text("title"),
        context=clean_text("selftext"),
        answer=clean_text(best_answer("answers.text", "answers.score")),
    )


def qa_from_pairs(df: DataFrame, corpus: str = "wikihow") -> DataFrame:
    """query, passage; the first corpus has an empty context."""
    extra = {"context": F.lit("")} if corpus == "eli5" else {}
    return _qa(df, corpus, question=clean_text("query"), answer=clean_text("passage"), **extra)


def qa_from_flat(df: DataFrame, corpus: str = "eli5") -> DataFrame:
    """title, selftext, answer."""
    return _qa(
        df,
        corpus,
        question=clean_text("title"),
        context=clean_text("selftext"),
        answer=clean_text("answer"),
    )


def qa_from_distractors(df: DataFrame, corpus: str = "sciq") -> DataFrame:
    """question, correct_answer, support and three wrong answers, kept as they are."""
    wrong = [or_empty(f"distractor{i}") for i in (1, 2, 3)]
    return _qa(
        df,
        corpus,
        question=clean_text("question"),
        answer=clean_text("correct_answer"),
        support=clean_text("support"),
        distractors=F.array(*wrong),
    )


def qa_from_keyed_choices(df: DataFrame, corpus: str = "openbookqa") -> DataFrame:
    """question_stem, fact1, choices{label, text}, answerKey."""
    choice = lookup_choice("choices.label", "choices.text", clean_text("answerKey"))
    return _qa(
        df,
        corpus,
        question=clean_text("question_stem"),
        answer=clean_text(choice),
        fact=clean_text("fact1"),
        all_choices=F.coalesce(F.col("choices.text"), F.array().cast("array<string>")),
    )


def qa_from_articles(df: DataFrame, corpus: str = "wikihow") -> DataFrame:
    """title, summary, article_text: the summary answers, else the article."""
    title = clean_text(or_default(F.col("title"), fixed.ARTICLE_TITLE))
    body = F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.col("article_text"))
    return _qa(
        df,
        corpus,
        question=F.concat(F.lit(fixed.ARTICLE_QUESTION), title),
        answer=clean_text(body),
    )
