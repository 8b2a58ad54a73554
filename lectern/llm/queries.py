"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.alignment import align_tokens, with_link_counts
from lectern.llm.fingerprints import edited_fingerprints, written
from lectern.llm.mixing import SQL as SQL_MIX
from lectern.llm.mixing import mix
from lectern.llm.neighbours import nearest
from lectern.llm.packing import pack
from lectern.llm.personal import KINDS, find_personal, span_list
from lectern.llm.prefix_trie import SQL as SQL_TRIE
from lectern.llm.prefix_trie import numbered_turns, prefix_trie, rebuilt
from lectern.llm.quality import quality
from lectern.llm.registry import query, table
from lectern.llm.repeats import without_repeats
from lectern.llm.shingle_join import SQL as SQL_JOIN
from lectern.llm.shingle_join import shingle_join
from lectern.llm.token_counts import token_counts
from lectern.llm.top_k import SQL as SQL_TOP
from lectern.llm.top_k import top_k
from lectern.llm.urls import Rule, filter_urls

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query("op5_packing")
def packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(table(spark, folder, "documents"), VOCABULARY)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group",
    )


@query("op6_token_counts")
def counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), VOCABULARY)


@query("op2_mixing", SQL_MIX)
def mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"))


@query("op7_personal_data")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Counts are of plain identifiers; ``n_added`` counts those found behind disguises."""
    found = find_personal(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def n(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[n(kind) for kind in KINDS],
        F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )


@query("op10_quality")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_syncmers")
def syncmers(spark: SparkSession, folder: str) -> DataFrame:
    found = edited_fingerprints(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("anchors")).alias("fingerprint"),
        written(F.col("edited_anchors")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


RULES = [
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
]


@query("op3_url_filter")
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"), RULES)


@query("op8_nearest")
def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return nearest(rows, rows.filter("vec_id % 20 = 0"))


@query("op1_shingle_join", SQL_JOIN)
def joined_shingles(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_join(table(spark, folder, "documents"))


@query("op4_repeats")
def repeats(spark: SparkSession, folder: str) -> DataFrame:
    rows = without_repeats(table(spark, folder, "documents"))
    return rows.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        ((F.col("n_bytes") - F.octet_length("kept")) / F.greatest("n_bytes", F.lit(1))).alias("share_removed"),
        # Cuts may part a character's bytes, whose rest is replaced.
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


@query("op13_top_k", SQL_TOP)
def exact_top(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return top_k(rows, rows.filter("vec_id % 100 = 0"))


@query("op12_alignment")
def alignment(spark: SparkSession, folder: str) -> DataFrame:
    rows = align_tokens(table(spark, folder, "documents"), VOCABULARY, PIECES)
    hashed = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    rows = rows.withColumn("groups_sha256", hashed).drop("groups")
    return with_link_counts(rows, VOCABULARY, PIECES)


@query("op11_prefix_trie", SQL_TRIE)
def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = numbered_turns(table(spark, folder, "conversations"))
    return prefix_trie(*rebuilt(turns)).drop("node", "parent")
