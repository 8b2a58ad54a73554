"""Corpora to training files, and augmentation of the training split."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.operators.chat import (
    ANALOGY_SEED,
    EXAMPLES_SEED,
    STEPS_SEED,
    augment_analogy,
    augment_examples,
    augment_steps,
    augmentation_stats,
    build_messages,
    length_stats,
)
from lectern.operators.hooks import BACK_SEED, Translator, back_translate
from lectern.operators.sampling import (
    DEFAULT_SEED,
    concat_sets,
    exact_split,
    samples,
    seeded_shuffle,
    split_counts,
)
from lectern.session import discard, fresh_path, together
from lectern.sources.jsonl import read_chat_jsonl, write_chat_jsonl, write_stats
from lectern.sources.qa import head_n

TRAIN_SHARE = 0.95


def prepare(sources: dict[str, DataFrame], n: int | None = None) -> DataFrame:
    """QA rows of all corpora (at most ``n`` each) as one set of chat records, with ids that
    are unique across corpora."""
    parts = []
    for corpus, qa in sources.items():
        records = build_messages(head_n(qa, n).withColumn("corpus", F.lit(corpus)))
        parts.append(records.withColumn("key", F.concat_ws(":", "corpus", "key")))
    return concat_sets(*parts)


def prepare_stats(split: DataFrame, corpora: Iterable[str] = fixed.CORPORA) -> DataFrame:
    """One row: length statistics per corpus, record counts per split."""
    lengths = length_stats(split, "corpus").withColumnRenamed("corpus", "name")
    counts = split_counts(split).select(
        F.concat(F.lit("split "), "split").alias("name"), F.col("rows").alias("total")
    )
    rows = lengths.unionByName(counts, allowMissingColumns=True)

    def of(name: str, *columns: Column | str) -> Column:
        return F.max(F.when(F.col("name") == name, F.struct(*columns)))

    count = F.col("total").alias("count")
    combined = [of(f"split {s}", count).alias(s) for s in ("train", "val")]
    return rows.agg(
        *[of(c, "total", "avg_user_len", "avg_assistant_len").alias(c) for c in corpora],
        F.struct(*combined).alias("combined"),
    )


def run_prepare(
    sources: dict[str, DataFrame],
    out: str,
    n: int | None = None,
    seed: int | str = DEFAULT_SEED,
    frac: float = TRAIN_SHARE,
) -> DataFrame:
    """Write per-corpus records, the shuffled train and validation sets, and statistics.

    The sources are read once, into a Parquet stage by corpus; all else reads the stage, and
    finding the split reads only its ids. Gives the statistics.
    """
    spark = next(iter(sources.values())).sparkSession
    stage_path = fresh_path(spark, "prepare")
    prepared = prepare(sources, n)
    prepared.write.partitionBy("corpus").parquet(stage_path)
    stage = spark.read.schema(prepared.schema).parquet(stage_path)

    def write_corpus(corpus: str) -> None:
        records = stage.filter(F.col("corpus") == corpus)
        write_chat_jsonl(records, f"{out}/{corpus}_instructions.jsonl")

    def write_part(name: str) -> None:
        part = seeded_shuffle(split.filter(F.col("split") == name), "key", seed)
        write_chat_jsonl(part, f"{out}/combined_{name}.jsonl")

    split, *_ = together(
        spark,
        lambda: exact_split(stage, "key", frac, seed),
        *[partial(write_corpus, corpus) for corpus in sources],
    )
    stats = prepare_stats(split, sources)
    stats = spark.createDataFrame(stats.collect(), stats.schema)
    together(
        spark,
        lambda: write_part("train"),
        lambda: write_part("val"),
        lambda: write_stats(stats, f"{out}/dataset_stats.json"),
    )
    discard(spark, stage_path)
    return stats


def augment(
    train: DataFrame,
    sizes: dict[str, int] | None = None,
    make_translator: Callable[[], Translator] | None = None,
    pivot: str = "de",
    key: str = "key",
) -> DataFrame:
    """The records and their augmented copies in one set, marked by ``kind``; ``record`` is the
    object of a record as it was read, null for copies."""
    size = {"analogies": 1000, "examples": 1000, "step_by_step": 1000, "back_translation": 500}
    size.update(sizes or {})
    seeds = {"analogies": ANALOGY_SEED, "examples": EXAMPLES_SEED, "step_by_step": STEPS_SEED}
    if make_translator is not None:
        seeds["back_translation"] = BACK_SEED
    # All samples are found together.
    chosen = dict(zip(seeds, samples(train, [(size[k], seed) for k, seed in seeds.items()], key)))
    kinds = {
        "original": train,
        "analogies": augment_analogy(train, key=key, chosen=chosen["analogies"]),
        "examples": augment_examples(train, key=key, chosen=chosen["examples"]),
        "step_by_step": augment_steps(train, key=key, chosen=chosen["step_by_step"]),
    }
    if make_translator is not None:
        kinds["back_translated"] = back_translate(
            train, make_translator, pivot=pivot, key=key, chosen=chosen["back_translation"]
        )
    none = F.lit(None).cast("string").alias("record")
    return concat_sets(
        *[
            df.select(key, "messages", "record" if "record" in df.columns else none, F.lit(kind).alias("kind"))
            for kind, df in kinds.items()
        ]
    )


FILES = {
    "analogies": "with_analogies.jsonl",
    "examples": "with_examples.jsonl",
    "step_by_step": "step_by_step.jsonl",
    "back_translated": "back_translated.jsonl",
}


def _numbered_lines(records: DataFrame) -> tuple[DataFrame, str]:
    """``key, messages, record``: lines named by the hash of their text and their number among
    equal lines; and where the hashes of repeated lines lie, which it reads.

    Only hashes are grouped to find what repeats, and only repeated lines are shuffled.
    """
    spark = records.sparkSession
    lines = records.select(F.sha1("record").alias("id"), "messages", "record")
    path = fresh_path(spark, "repeated")
    lines.groupBy("id").count().filter("count > 1").select("id").write.parquet(path)
    repeated = spark.read.schema("id string").parquet(path)
    once = lines.join(repeated, "id", "left_anti").withColumn("nth", F.lit(1))
    firsts = [F.any_value(c).alias(c) for c in ("messages", "record")]
    equal = lines.join(repeated, "id", "left_semi").groupBy("id").agg(*firsts, F.count("*").alias("n"))
    each = F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth")
    numbered = once.unionByName(equal.select("id", "messages", "record", each))
    key = F.concat_ws(":", "id", F.col("nth").cast("string")).alias("key")
    return numbered.select(key, "messages", "record"), path


def run_augment(
    spark: SparkSession,
    train_path: str,
    out: str,
    sizes: dict[str, int] | None = None,
    make_translator: Callable[[], Translator] | None = None,
    pivot: str = "de",
    seed: int | str = DEFAULT_SEED,
) -> DataFrame:
    """Augment a training file; write each kind, the shuffled union, and the counts.

    Lines carry no id, so each is named by the hash of its text and its number among equal
    lines, which are counted. So a sample is fixed by the seed and the lines, however they
    are laid out. Records that are not changed are written as they were read.
    """
    numbered, repeated = _numbered_lines(read_chat_jsonl(spark, train_path).records)
    train_stage, augmented_stage = fresh_path(spark, "numbered"), fresh_path(spark, "augmented")
    numbered.write.parquet(train_stage)
    train = spark.read.schema(numbered.schema).parquet(train_stage)
    augmented = augment(train, sizes, make_translator, pivot)
    augmented.write.partitionBy("kind").parquet(augmented_stage)
    stage = spark.read.schema(augmented.schema).parquet(augmented_stage)
    placed = stage.withColumn("_id", F.concat_ws(":", "kind", "key"))
    stats = augmentation_stats(stage)
    stats = spark.createDataFrame(stats.collect(), stats.schema)
    records = F.col("records")
    kinds = ("original", *FILES, "combined_augmented")
    counts = stats.agg(
        *[F.sum(F.when(F.col("kind") == k, records).otherwise(0)).alias(k) for k in kinds]
    )

    def write_kind(kind: str, file: str) -> None:
        write_chat_jsonl(stage.filter(F.col("kind") == kind), f"{out}/{file}")

    together(
        spark,
        lambda: write_chat_jsonl(
            seeded_shuffle(placed, "_id", seed), f"{out}/combined_augmented.jsonl"
        ),
        lambda: write_stats(counts, f"{out}/augmentation_stats.json"),
        *[partial(write_kind, kind, file) for kind, file in FILES.items()],
    )
    discard(spark, train_stage, augmented_stage, repeated)
    return stats


def sizes_from(config: dict[str, Any]) -> dict[str, int]:
    """The sample sizes of an augmentation configuration."""
    names = ("analogies", "examples", "step_by_step", "back_translation")
    return {name: int(config[name]) for name in names if name in config}
