"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents its predecessor kept and decides on the columns of documents;
the last one returns token sequences.

A null text is empty to every stage: it is scored like any other, has no near copies, holds no
personal data and no words, and is packed as its end alone. Rows with a null id are never
trained on and come last where ids decide; rows equal in id and text are one document to
``near_copies``, and extra columns stay with their rows up to the last stage. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.mixing import mixed_documents
from lectern.llm.packing import pack
from lectern.llm.personal import redacted
from lectern.llm.quality import good_documents
from lectern.llm.queries import VOCABULARY
from lectern.llm.registry import prepare, table
from lectern.llm.shingle_join import one_of_each
from lectern.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier doesn't reject."""
    prepare(spark)
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepare(spark)
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    prepare(spark)
    return measured(docs.withColumn("text", redacted("text")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repetitions of documents that bring the sources near their target weights."""
    prepare(spark)
    return measured(mixed_documents(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token sequences."""
    prepare(spark)
    return pack(docs, VOCABULARY)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("mix", mix),
    ("sequences", sequences),
]

#: The classifier, the tokenizer and deobfuscation have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
