"""Quality flags, BLEU, ROUGE-L and training-log metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import occurrences, or_empty
from lectern.schemas import QUIZ_ITEM
from lectern.session import materialise

# Accepted length, length of a sample, the digits beyond the decimal ones.
MIN_CHARS, MAX_CHARS = 200, 2000
SAMPLE_CHARS = 500
DIGIT = "[\\p{Nd}²³¹⁰⁴-⁹₀-₉]"

# The rules of the public mteval-v13a tokenizer, in their order. The texts are
# replaced first; the text is then padded with spaces for the patterns. (The first pattern
# has "!" where the original has the space before it, which only adds spaces to spaces.)
BLEU_TEXTS = (
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
)
BLEU_PATTERNS = (
    ("([\\{-\\~\\[-\\`!-\\&\\(-\\+\\:-\\@\\/])", " $1 "),
    ("([^0-9])([\\.,])", "$1 $2 "),
    ("([\\.,])([^0-9])", " $1 $2"),
    ("([0-9])(-)", "$1 $2 "),
)
MAX_ORDER = 4


def quality_flags(text: Column | str) -> list[Column]:
    text = F.col(text) if isinstance(text, str) else text
    text = or_empty(text)
    return [
        F.length(text).between(MIN_CHARS, MAX_CHARS).alias("length_ok"),
        (F.length(text) > 0).alias("has_intro_or_summary"),
        (occurrences(text, "\n\n") >= 2).alias("has_structure"),
    ]


def explanation_quality(df: DataFrame, text: str = "explanation") -> DataFrame:
    return df.select("*", *quality_flags(text))


def _texts(col: str) -> Column:
    return F.coalesce(F.col(col), F.array().cast("array<string>"))


def analogy_flags(col: str = "analogies") -> list[Column]:
    says_like = F.exists(_texts(col), lambda t: F.lower(or_empty(t)).contains("like"))
    return [F.size(_texts(col)).alias("count"), says_like.alias("has_everyday_language")]


def analogy_quality(df: DataFrame, col: str = "analogies") -> DataFrame:
    return df.select("*", *analogy_flags(col))


def example_flags(col: str = "examples") -> list[Column]:
    concrete = F.exists(
        _texts(col),
        lambda t: F.lower(or_empty(t)).contains("for example") | or_empty(t).rlike(DIGIT),
    )
    return [F.size(_texts(col)).alias("count"), concrete.alias("concrete")]


def example_quality(df: DataFrame, col: str = "examples") -> DataFrame:
    return df.select("*", *example_flags(col))


def quiz_flags(col: str = "items") -> list[Column]:
    items = F.coalesce(F.col(col), F.array().cast(f"array<{QUIZ_ITEM}>"))
    return [
        F.size(items).alias("count"),
        F.forall(items, lambda i: F.length(or_empty(i["rationale"])) > 0).alias("has_rationales"),
        F.forall(items, lambda i: F.coalesce(F.size(i["options"]), F.lit(0)) >= 3).alias(
            "options_plausible"
        ),
    ]


def quiz_quality(df: DataFrame, col: str = "items") -> DataFrame:
    return df.select("*", *quiz_flags(col))


def topic_scores(df: DataFrame) -> DataFrame:
    """Scores and samples per topic from ``domain, topic, explanation, analogies, examples,
    items``; the sample of the explanation is its first 500 characters."""
    return df.select(
        "domain",
        "topic",
        F.struct(*quality_flags("explanation")).alias("explanation_scores"),
        F.struct(*analogy_flags("analogies")).alias("analogies_scores"),
        F.struct(*example_flags("examples")).alias("examples_scores"),
        F.struct(*quiz_flags("items")).alias("quiz_scores"),
        F.left(or_empty("explanation"), F.lit(SAMPLE_CHARS)).alias("sample"),
    )


def quality_report(scores: DataFrame, *by: str) -> DataFrame:
    """Share of topics that pass each flag, per group."""

    def rate(flag: str, name: str) -> Column:
        return F.avg(F.col(flag).cast("int")).alias(name)

    return scores.groupBy(*(by or ("domain",))).agg(
        F.count("*").alias("topics"),
        rate("explanation_scores.length_ok", "length_ok"),
        rate("explanation_scores.has_intro_or_summary", "has_intro_or_summary"),
        rate("explanation_scores.has_structure", "has_structure"),
        rate("analogies_scores.has_everyday_language", "has_everyday_language"),
        rate("examples_scores.concrete", "concrete"),
        rate("quiz_scores.has_rationales", "has_rationales"),
        rate("quiz_scores.options_plausible", "options_plausible"),
    )


def report_lines(scores: DataFrame) -> DataFrame:
    """The markdown report as ``domain, part, topic, line``; sorted by the first three it
    reads from the title (part 0) over each domain's heading, topics and blank line."""
    kinds = ("explanation", "analogies", "examples", "quiz")
    flags = F.to_json(F.struct(*[f"{k}_scores" for k in kinds]))
    topics = scores.select(
        "domain",
        F.lit(2).alias("part"),
        "topic",
        F.concat(F.lit("- **"), F.col("topic"), F.lit("**: "), flags).alias("line"),
    )
    around = scores.groupBy("domain").agg(
        F.array(
            F.struct(F.lit(1).alias("part"), F.concat(F.lit("## "), "domain").alias("line")),
            F.struct(F.lit(3).alias("part"), F.lit("").alias("line")),
        ).alias("l")
    )
    headings = around.select("domain", F.explode("l").alias("l")).select(
        "domain", "l.part", F.lit("").alias("topic"), "l.line"
    )
    return topics.unionByName(headings)


def write_report(scores: DataFrame, path: str) -> None:
    """``<path>/report.json``: one JSON line per topic. ``<path>/report.md``: title and
    lines, as text parts in reading order. The scores are computed once."""
    scores = materialise(scores, "scores")
    scores.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(
        f"{path}/report.json"
    )
    title = scores.sparkSession.createDataFrame(
        [("", 0, "", "# Validation Report"), ("", 1, "", "")],
        "domain string, part int, topic string, line string",
    )
    lines = title.unionByName(report_lines(scores)).orderBy("domain", "part", "topic")
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(f"{path}/report.md")


def bleu_text(col: Column | str) -> Column:
    """The text with white space around every mteval-v13a token."""
    text = or_empty(col)
    for old, new in BLEU_TEXTS:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, new in BLEU_PATTERNS:
        text = F.regexp_replace(text, pattern, new)
    return text


def _matches(hyp: list[str], ref: list[str]) -> list[int]:
    """How many n-grams (n = 1..4) two texts share, each counted as often as in both.

    An n-gram is a number: the one of its first n - 1 words paired with its last word.
    """
    numbers: dict[str, int] = {}
    words = [numbers.setdefault(w, len(numbers)) for w in hyp + ref]
    last_h, last_r = np.split(np.array(words, np.int64), [len(hyp)])
    grams_h, grams_r = last_h, last_r
    shared = []
    for n in range(1, MAX_ORDER + 1):
        if n > 1:
            pairs = [
                grams[:-1] * len(numbers) + last[n - 1 :]
                for grams, last in ((grams_h, last_h), (grams_r, last_r))
            ]
            _, renumbered = np.unique(np.concatenate(pairs), return_inverse=True)
            grams_h, grams_r = np.split(renumbered, [len(pairs[0])])
        size = max(grams_h.max(initial=-1), grams_r.max(initial=-1)) + 1
        counts = [np.bincount(g, minlength=size) for g in (grams_h, grams_r)]
        shared.append(int(np.minimum(*counts).sum()))
    return shared


def _counts(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Shared n-grams of each pair, and the number of words on both sides."""
    for hyps, refs in pairs:
        words = ((h.split(), r.split()) for h, r in zip(hyps, refs))
        yield pd.Series([[*_matches(h, r), len(h), len(r)] for h, r in words], dtype="object")


def ngram_totals(df: DataFrame, hyp: str, ref: str, by: list[str]) -> DataFrame:
    """Per group: ``matched_n``, ``hyp_n`` and ``ref_n`` for n = 1..4.

    A pair's n-grams are counted in its own row: exploding and grouping them would shuffle
    many times the size of the texts.
    """
    orders = range(1, MAX_ORDER + 1)
    count = F.pandas_udf(_counts, "array<bigint>")
    counted = df.select(*by, count(bleu_text(hyp), bleu_text(ref)).alias("c"))
    length = {"hyp": F.get("c", F.lit(MAX_ORDER)), "ref": F.get("c", F.lit(MAX_ORDER + 1))}
    sums = []
    for n in orders:
        sums.append(F.sum(F.get("c", F.lit(n - 1))).alias(f"matched_{n}"))
        for side, words in length.items():
            grams = F.greatest(words - (n - 1), F.lit(0))
            sums.append(F.sum(grams).alias(f"{side}_{n}"))
    return counted.groupBy(*by).agg(*sums)


def bleu_score() -> Column:
    """BLEU (Papineni et al. 2002) from the totals: brevity penalty times the geometric mean
    of the clipped precisions; the k-th order without a match counts as 1 / 2**k matches."""
    orders = range(1, MAX_ORDER + 1)
    log_sum, misses = F.lit(0.0), F.lit(0)
    for n in orders:
        matched, total = F.col(f"matched_{n}"), F.col(f"hyp_{n}")
        misses = misses + F.when(matched == 0, 1).otherwise(0)
        found = F.when(matched == 0, F.pow(F.lit(2.0), -misses)).otherwise(matched)
        log_sum = log_sum + F.ln(F.try_divide(found.cast("double"), total))
    brevity = F.when(
        F.col("hyp_1") < F.col("ref_1"),
        F.exp(1 - F.try_divide(F.col("ref_1"), F.col("hyp_1"))),
    ).otherwise(F.lit(1.0))
    some = sum((F.col(f"matched_{n}") for n in orders), F.lit(0)) > 0
    full = F.least(*[F.col(f"hyp_{n}") for n in orders]) > 0
    return F.when(some & full, 100 * brevity * F.exp(log_sum / MAX_ORDER)).otherwise(F.lit(0.0))


def corpus_bleu(df: DataFrame, hyp: str, ref: str, *by: str) -> DataFrame:
    """``bleu`` (0..100) per group against one reference."""
    return ngram_totals(df, hyp, ref, list(by)).select(*by, bleu_score().alias("bleu"))


def _lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence with one bit per word of ``a``."""
    where: dict[str, int] = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | (1 << i)
    full = (1 << len(a)) - 1
    open_bits = full
    for word in b:
        hit = open_bits & where.get(word, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return len(a) - open_bits.bit_count()


def _rouge_l(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for hyps, refs in pairs:
        scores = []
        for hyp, ref in zip((h.split() for h in hyps), (r.split() for r in refs)):
            both = len(hyp) + len(ref)
            scores.append(2 * _lcs_length(hyp, ref) / both if both else 0.0)
        yield pd.Series(scores, dtype="float64")


def rouge_text(col: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits, with a space between."""
    return F.regexp_replace(F.lower(or_empty(col)), "[^a-z0-9]+", " ")


def rouge_l(df: DataFrame, hyp: str, ref: str, *by: str) -> DataFrame:
    """Mean F-measure of the longest common subsequence (Lin 2004) per group."""
    score = F.pandas_udf(_rouge_l, "double")
    scored = df.select(*by, score(rouge_text(hyp), rouge_text(ref)).alias("f"))
    return scored.groupBy(*by).agg(F.avg("f").alias("rouge_l"))


def perplexity(df: DataFrame, loss: str = "eval_loss", *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.exp(F.avg(loss)).alias("perplexity"))


def last_eval(logs: DataFrame, run: str = "run") -> DataFrame:
    """The latest record with an eval loss, per run."""
    rest = [c for c in logs.columns if c != run]
    evals = logs.filter(F.col("eval_loss").isNotNull())
    return evals.groupBy(run).agg(F.max_by(F.struct(*rest), "step").alias("r")).select(run, "r.*")


def best_checkpoint(logs: DataFrame, run: str = "run") -> DataFrame:
    """The record with the lowest eval loss, the earliest one on ties, per run."""
    rest = [c for c in logs.columns if c != run]
    evals = logs.filter(F.col("eval_loss").isNotNull())
    best = F.min_by(F.struct(*rest), F.struct("eval_loss", "step")).alias("r")
    return evals.groupBy(run).agg(best).select(run, "r.*")
