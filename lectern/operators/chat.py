"""Chat records: building, augmenting, validating and measuring them.

Each record is one row with its messages as an array, so all of this is projection,
filtering and map-side aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.text import clean_text, fill, or_empty
from lectern.operators.sampling import DEFAULT_SEED, sample_n


def message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def user_turn(corpus: Column | str, templates: dict[str, str] | None = None) -> Column:
    """The user text for a QA row, by corpus name in any case."""
    corpus = F.lower(F.col(corpus) if isinstance(corpus, str) else corpus)
    parts = {name: F.col(name) for name in ("question", "context", "support", "fact")}
    turn = F.when(F.lit(False), F.lit(""))
    for name, template in (templates or fixed.USER_TURNS).items():
        turn = turn.when(corpus == name, fill(template, parts))
    return turn.otherwise(fill(fixed.OTHER_USER_TURN, parts))


def render_user_turn(df: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    return df.withColumn("user_turn", user_turn("corpus", templates))


def build_messages(
    df: DataFrame, with_system: bool = True, system_text: str = fixed.SYSTEM_TEXT
) -> DataFrame:
    """QA rows as chat records: ``key``, ``corpus``, ``messages``."""
    turns = [
        message("user", user_turn("corpus")),
        message("assistant", clean_text("answer")),
    ]
    if with_system:
        turns.insert(0, message("system", F.lit(system_text)))
    return df.select("key", "corpus", F.array(*turns).alias("messages"))


def has_role(messages: Column | str, role: str) -> Column:
    return F.exists(messages, lambda m: F.coalesce(m["role"] == role, F.lit(False)))


def _copy(m: Column, suffix: str = "") -> Column:
    extra = F.when(m["role"] == "user", F.lit(suffix)).otherwise(F.lit(""))
    return message(
        F.coalesce(m["role"], F.lit("user")),
        F.concat(or_empty(m["content"]), extra),
    )


def append_to_user_turns(
    df: DataFrame,
    suffix: str,
    n: int,
    key: str = "key",
    seed: int | str = DEFAULT_SEED,
    chosen: Column | None = None,
) -> DataFrame:
    """A sample of ``n`` records, or those ``chosen`` is true for, with ``suffix`` after every
    user message; a copy has no ``record``."""
    sampled = sample_n(df, n, key, seed) if chosen is None else df.filter(chosen)
    return sampled.drop("record").withColumn("messages", F.transform("messages", lambda m: _copy(m, suffix)))


ANALOGY_SEED, EXAMPLES_SEED, STEPS_SEED = (f"{DEFAULT_SEED}-{kind}" for kind in ("analogy", "examples", "steps"))


def augment_analogy(
    df: DataFrame, n: int = 1000, key: str = "key", seed: int | str = ANALOGY_SEED, chosen: Column | None = None
) -> DataFrame:
    return append_to_user_turns(df, fixed.ANALOGY_REQUEST, n, key, seed, chosen)


def augment_examples(
    df: DataFrame, n: int = 1000, key: str = "key", seed: int | str = EXAMPLES_SEED, chosen: Column | None = None
) -> DataFrame:
    return append_to_user_turns(df, fixed.EXAMPLES_REQUEST, n, key, seed, chosen)


def augment_steps(
    df: DataFrame, n: int = 1000, key: str = "key", seed: int | str = STEPS_SEED, chosen: Column | None = None
) -> DataFrame:
    return append_to_user_turns(df, fixed.STEPS_REQUEST, n, key, seed, chosen)


def replace_first_assistant(df: DataFrame, new_text: Column | str) -> DataFrame:
    """The first assistant message gets ``new_text``; the others are copied. A copy has no
    ``record``."""
    new_text = F.col(new_text) if isinstance(new_text, str) else new_text
    roles = F.transform("messages", lambda m: F.coalesce(m["role"], F.lit("user")))
    first = F.array_position(roles, "assistant") - 1
    swapped = F.transform(
        "messages",
        lambda m, i: F.when(i == first, message("assistant", new_text)).otherwise(_copy(m)),
    )
    return df.drop("record").withColumn("messages", swapped)


def violations_of(messages: Column | str = "messages") -> Column:
    """Violated rules of one record; a record without a list breaks only that rule."""
    m = F.col(messages) if isinstance(messages, str) else messages
    known = F.array(*[F.lit(r) for r in fixed.ROLES])
    bad_role = F.exists(
        m,
        lambda x: x.isNotNull() & ~F.coalesce(F.array_contains(known, x["role"]), F.lit(False)),
    )
    no_content = F.exists(m, lambda x: x.isNotNull() & (or_empty(x["content"]) == ""))
    found = F.array(
        F.when(bad_role, fixed.BAD_ROLE),
        F.when(no_content, fixed.NO_CONTENT),
        F.when(~has_role(m, "user"), fixed.NO_USER),
        F.when(~has_role(m, "assistant"), fixed.NO_ASSISTANT),
    )
    return F.when(m.isNull(), F.array(F.lit(fixed.NO_MESSAGES))).otherwise(F.array_compact(found))


def validate_chat(df: DataFrame, key: str = "key") -> DataFrame:
    """One row per violation: ``key``, ``violation``."""
    return df.select(key, F.explode(violations_of()).alias("violation"))


def validity(df: DataFrame) -> DataFrame:
    """One row: whether all records are valid, and how often each rule is broken."""
    found = df.select(violations_of().alias("v"))
    counts = [
        F.count_if(F.array_contains("v", name)).alias(name.replace(" ", "_"))
        for name in fixed.VIOLATIONS
    ]
    return found.agg(
        F.coalesce(F.bool_and(F.size("v") == 0), F.lit(True)).alias("valid"),
        F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("errors"),
        *counts,
    )


def _role_size(role: str, what: str) -> Column:
    chosen = F.filter("messages", lambda m: m["role"] == role)
    if what == "messages":
        return F.size(chosen)
    return F.aggregate(chosen, F.lit(0), lambda n, m: n + F.length(or_empty(m["content"])))


def length_stats(df: DataFrame, *by: str | Column) -> DataFrame:
    """Records and mean characters per user and per assistant message, 0.0 without any."""
    sized = df.select(
        *by,
        *[
            F.coalesce(_role_size(role, what), F.lit(0)).alias(f"{role}_{what}")
            for role in ("user", "assistant")
            for what in ("messages", "chars")
        ],
    )
    groups = sized.columns[: len(by)]
    means = [
        F.coalesce(F.try_divide(F.sum(f"{role}_chars"), F.sum(f"{role}_messages")), F.lit(0.0))
        .cast("double")
        .alias(f"avg_{role}_len")
        for role in ("user", "assistant")
    ]
    return sized.groupBy(*groups).agg(F.count("*").alias("total"), *means)


def augmentation_stats(df: DataFrame) -> DataFrame:
    """Records per ``kind`` and, in the row "combined_augmented", of all kinds."""
    return (
        df.rollup("kind")
        .agg(F.count("*").alias("records"), F.grouping("kind").alias("all"))
        .select(
            F.when(F.col("all") == 1, "combined_augmented").otherwise(F.col("kind")).alias("kind"),
            "records",
        )
    )
