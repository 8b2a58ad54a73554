"""Chat records and statistics as JSON lines."""

from __future__ import annotations

import json
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.frames import once
from lectern.functions.json import OPTIONS, has_key, is_object, keys, read_json, whole_json
from lectern.functions.text import clean_text
from lectern.schemas import MESSAGES

BAD_JSON = "not JSON"
NOT_AN_OBJECT = "not an object"
NO_MESSAGES_KEY = "no messages key"


class ChatRead(NamedTuple):
    """Kept records (``messages``, and ``record``, the object as it was read) and dropped lines
    (``reason``, ``line``)."""

    records: DataFrame
    rejects: DataFrame


def _reason(json: Column) -> Column:
    return (
        F.when(json.isNull(), BAD_JSON)
        .when(~is_object(json), NOT_AN_OBJECT)
        .when(~has_key(keys(json), "messages"), NO_MESSAGES_KEY)
    )


def _messages(json: Column) -> Column:
    """The list of messages; null when there is none. Items that are no objects are null."""
    listed = read_json(json, f"messages {MESSAGES.simpleString()}")["messages"]
    item = MESSAGES.elementType.simpleString()
    mixed = F.transform(
        read_json(json, "messages array<string>")["messages"],
        lambda m: F.when(is_object(m), read_json(m, item)),
    )
    return F.coalesce(listed, mixed)


def classify_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Non-blank lines: ``line``, ``reason`` (why it cannot be used, null for good ones) and
    ``messages`` (null when they are not a list)."""
    text = lines.withColumn("line", clean_text(column)).filter(F.length("line") > 0)
    parsed = once(text, _json=whole_json(F.col("line")))
    judged = once(parsed, reason=_reason(F.col("_json")))
    good = F.when(F.col("reason").isNull(), F.col("_json"))
    return once(judged, messages=_messages(good)).drop("_json")


def parse_chat_lines(lines: DataFrame, column: str = "value") -> ChatRead:
    """Chat records from a frame of text lines; other columns are carried along."""
    classified = classify_lines(lines, column)
    carried = [c for c in lines.columns if c != column]
    good = classified.filter(F.col("reason").isNull())
    return ChatRead(
        good.select(*carried, "messages", F.col("line").alias("record")),
        classified.filter(F.col("reason").isNotNull()).select(*carried, "reason", "line"),
    )


def read_chat_jsonl(spark: SparkSession, path: str) -> ChatRead:
    """Tolerant read of JSON lines; a missing path is an error."""
    return parse_chat_lines(spark.read.text(path))


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("reason").agg(F.count("*").alias("lines"))


def read_chat_splits(spark: SparkSession, train: str, val: str) -> dict[str, DataFrame]:
    """Strict read of two splits (``messages`` and ``record``, the object as it was read):
    broken lines fail the job, and each split must hold a record with ``messages``. The check
    stops at the first such record."""
    schema = T.StructType([T.StructField("messages", MESSAGES)])
    splits = {}
    for name, path in (("train", train), ("validation", val)):
        lines = spark.read.text(path).filter(F.length(clean_text("value")) > 0)
        read = F.from_json("value", schema, {**OPTIONS, "mode": "FAILFAST"})
        df = once(lines, _read=read).select("_read.messages", F.col("value").alias("record"))
        if df.filter(F.col("messages").isNotNull()).isEmpty():
            raise ValueError(f"split {name!r} lacks a 'messages' column")
        splits[name] = df
    return splits


def as_json_line(*columns: str) -> Column:
    """One JSON object per row; nulls stay visible, non-ASCII text stays as it is."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_chat_jsonl(df: DataFrame, path: str, metadata: dict[str, Any] | None = None) -> None:
    """Chat records as JSON lines, with an optional one-line ``<path>.meta.json``.

    A record that has ``record``, the object as it was read, is written as that, with all its
    fields; operators that change messages leave it out.
    """
    line = as_json_line("messages")
    if "record" in df.columns:
        line = F.coalesce(F.col("record"), line)
    df.select(line.alias("value")).write.mode("overwrite").text(path)
    if metadata is not None:
        note = df.sparkSession.createDataFrame([(json.dumps(metadata, ensure_ascii=False),)], "value string")
        note.coalesce(1).write.mode("overwrite").text(path.removesuffix(".jsonl") + ".meta.json")


def write_stats(df: DataFrame, path: str) -> None:
    """A one-row statistics frame as one JSON document."""
    df.select(as_json_line("*").alias("value")).coalesce(1).write.mode("overwrite").text(path)
