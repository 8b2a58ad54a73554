"""Caller-supplied models. A hook is a factory that returns a function over a batch. It is
called once per Python worker, so a model is loaded once and then serves all tasks of that
worker. Only the columns a model needs go through Python, in Arrow batches.

Model calls are slow, so rows are spread over as many tasks as there are shuffle partitions
(or ``tasks``) ahead of the call; adaptive execution would judge them by their size in bytes
and put them into few tasks."""

from __future__ import annotations

import functools
import logging
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.text import or_empty, truncate_at_stop
from lectern.operators.chat import message, replace_first_assistant
from lectern.operators.context import chat_text
from lectern.operators.sampling import DEFAULT_SEED, sample_n
from lectern.operators.skew import join_per_key
from lectern.session import materialise

log = logging.getLogger(__name__)

# (texts, from language, to language) -> texts
Translator = Callable[[list[str], str, str], list[str]]
# image paths, or (path, bytes) where stored pictures are given -> captions
Captioner = Callable[[list[Any]], list[str]]
# requests with prompt, max_new_tokens, temperature, top_p, do_sample -> texts
Generator = Callable[[list[dict[str, Any]]], list[str]]


# How many models a Python worker keeps, the latest ones; a session may set another number.
MODELS_KEPT, KEPT = "spark.lectern.models.kept", 2
_models: dict[str, Callable] = {}
BACK_SEED = f"{DEFAULT_SEED}-back"
# A call adds at most so many files to a memo.
MEMO_FILES = 16


def _loaded(token: str, make: Callable[[], Callable], kept: int) -> Callable:
    """The model of a hook, loaded on first use in this worker."""
    if token in _models:
        _models[token] = _models.pop(token)
    else:
        model = make()
        while len(_models) >= kept:
            del _models[next(iter(_models))]
        _models[token] = model
    return _models[token]


def _model(spark: SparkSession, make: Callable[[], Callable]) -> Callable[[], Callable]:
    """What gives a hook's model in a worker."""
    kept = max(1, int(spark.conf.get(MODELS_KEPT, str(KEPT))))
    # A function of this module, so that workers share its models and get no copy.
    return functools.partial(_loaded, uuid.uuid4().hex, make, kept)


def spread(df: DataFrame, by: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Rows hashed by (unique) columns over a fixed number of tasks."""
    count = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, *by)


def _one_per_item(
    call: Callable[[list], list], items: list, size: int
) -> list[tuple[Any, str | None]]:
    """(result, error) per item, in batches; the items of a batch that fails are tried one by
    one."""
    out: list[tuple[Any, str | None]] = []
    for at in range(0, len(items), size):
        batch = items[at : at + size]
        try:
            results = call(batch)
            if len(results) != len(batch):
                raise ValueError("one result per item must come back")
            out += [(r, None) for r in results]
        except Exception as exc:
            if len(batch) == 1:
                out.append((None, str(exc) or type(exc).__name__))
            else:
                out += [_one_per_item(call, [item], 1)[0] for item in batch]
    return out


def back_translate(
    df: DataFrame,
    make_translator: Callable[[], Translator] | None,
    n: int = 500,
    pivot: str = "de",
    key: str = "key",
    seed: int | str = BACK_SEED,
    batch_size: int = 4,
    tasks: int | None = None,
    chosen: Column | None = None,
) -> DataFrame:
    """A sample of ``n`` records, or those ``chosen`` is true for, whose first assistant message
    is the third message, translated to the pivot language and back.

    A batch that fails is dropped and logged; without a translator nothing comes back.
    ``mismatch`` marks records whose third message is not the one replaced.
    """
    if make_translator is None:
        return df.limit(0).withColumn("mismatch", F.lit(False))
    model = _model(df.sparkSession, make_translator)

    @F.pandas_udf("struct<text:string,ok:boolean>")
    def there_and_back(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows: list[tuple[str | None, bool]] = []
            for at in range(0, len(texts), batch_size):
                batch = texts.iloc[at : at + batch_size].tolist()
                try:
                    translate = model()
                    back = translate(translate(batch, "en", pivot), pivot, "en")
                    if len(back) != len(batch):
                        raise ValueError("as many texts must come back as went in")
                    rows += [(text, True) for text in back]
                except Exception as exc:
                    log.warning("translation of a batch failed: %s", exc)
                    rows += [(None, False)] * len(batch)
            yield pd.DataFrame(rows, columns=["text", "ok"])

    third = F.get("messages", F.lit(2))
    text = F.when(F.size("messages") >= 3, or_empty(third["content"])).otherwise("")
    first = F.array_position(F.transform("messages", lambda m: m["role"]), "assistant")
    sampled = sample_n(df, n, key, seed) if chosen is None else df.filter(chosen)
    sampled = spread(sampled, [key], tasks)
    translated = (
        sampled.withColumn("mismatch", F.coalesce(first != 3, F.lit(True)))
        .withColumn("_back", there_and_back.asNondeterministic()(text))
        .filter("_back.ok")
    )
    return replace_first_assistant(translated, F.col("_back.text")).drop("_back")


def known_captions(spark: SparkSession, memo: str) -> DataFrame:
    """``key, caption`` of a memo, one row per key. Runs at the same time may both have asked
    for a picture; then either answer is kept."""
    schema = "key string, caption string"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(memo)
    return spark.read.schema(schema).parquet(memo).groupBy("key").agg(F.min("caption").alias("caption"))


def caption_images(
    images: DataFrame,
    make_captioner: Callable[[], Captioner],
    batch_size: int = 16,
    tasks: int | None = None,
    blobs: DataFrame | None = None,
    memo: str | None = None,
    key: str = "image_path",
) -> DataFrame:
    """``caption`` for each image with a path; each distinct ``key`` is captioned once. A column
    with the content's hash (``sha1``) as key also finds copies under other paths.

    With ``blobs`` (``deck, image_path, content``) the captioner gets (path, bytes) of the
    stored picture, of one deck's copy per key; else paths.

    ``memo``, a folder that all executors reach, keeps captions by key between calls: pictures
    it knows are not sent again, and what is captioned is added to it, failures aside. Keys
    should then name contents, as hashes do.

    The captions are written, so that the model runs once, and join back to the images
    whatever share of them one key has. A failure gives a placeholder.
    """
    spark, with_bytes = images.sparkSession, blobs is not None
    model = _model(spark, make_captioner)

    @F.pandas_udf("struct<caption:string,failed:boolean>")
    def captions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def call(pictures: list[Any]) -> list[str]:
            return model()(pictures)

        for pdf in batches:
            out = []
            paths = pdf["path"].tolist()
            pictures = list(zip(paths, pdf["content"])) if with_bytes else paths
            answers = _one_per_item(call, pictures, batch_size)
            for path, (caption, error) in zip(paths, answers):
                if error:
                    log.warning("no caption for %s: %s", path, error)
                out.append((fixed.NO_CAPTION if error else caption, error is not None))
            yield pd.DataFrame(out, columns=["caption", "failed"])

    # Images without a path have no key, and the join spreads them.
    path = F.nullif("image_path", F.lit(""))
    keyed = images.withColumn("_key", F.when(path.isNotNull(), F.coalesce(F.col(key).cast("string"), path)))
    per_key = keyed.filter(F.col("_key").isNotNull()).groupBy("_key")
    per_key = per_key.agg(F.min(F.struct(F.col("image_path").alias("_path"), F.col("deck").alias("_deck"))).alias("_copy"))
    per_key = per_key.select("_key", "_copy.*")
    if memo is not None:
        known = known_captions(spark, memo).select(F.col("key").alias("_key"), "caption")
        per_key = per_key.join(known, "_key", "left_anti")
    content = F.lit(None).cast("binary")
    if blobs is not None:
        stored = blobs.select(F.col("deck").alias("_deck"), F.col("image_path").alias("_path"), "content")
        per_key = per_key.join(stored, ["_deck", "_path"], "left")
        content = F.col("content")
    picture = F.struct(F.col("_path").alias("path"), content.alias("content"))
    captioned = spread(per_key, ["_key"], tasks).select("_key", captions(picture).alias("_out"))
    captioned = materialise(captioned.select("_key", "_out.*"), "captions")
    found = captioned.select("_key", "caption")
    if memo is not None:
        # What is joined below is fixed ahead of the addition to the memo.
        found = materialise(found.unionByName(known), "captions-known")
        added = captioned.filter("NOT failed").select(F.col("_key").alias("key"), "caption")
        added.coalesce(MEMO_FILES).write.mode("append").parquet(memo)
    return join_per_key(keyed, found, ["_key"]).drop("_key")


def text_as_messages(text: Column | str) -> Column:
    """A single prompt as one user turn."""
    return F.array(message("user", F.col(text) if isinstance(text, str) else text))


def generate(
    df: DataFrame,
    make_generator: Callable[[], Generator],
    max_new_tokens: Column | int = 256,
    temperature: Column | float = 0.7,
    top_p: Column | float = 0.9,
    do_sample: Column | bool = True,
    stops: list[str] | None = None,
    messages: str = "messages",
    batch_size: int = 32,
    spread_by: Sequence[str] = (),
    tasks: int | None = None,
) -> DataFrame:
    """``generated`` and ``error`` for message rows; parameters may differ by row.

    When a batch fails its rows are tried one by one, and those that fail again carry the
    error. Rows with null messages are not sent. The text is cut at the stops and stripped.
    With ``spread_by`` the rows are spread over tasks first.
    """
    model = _model(df.sparkSession, make_generator)

    @F.pandas_udf("struct<text:string,error:string>")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def call(requests: list[dict[str, Any]]) -> list[str]:
            return model()(requests)

        for pdf in batches:
            out = pd.DataFrame(None, index=pdf.index, columns=["text", "error"], dtype="object")
            sent = pdf[pdf["prompt"].notna()]
            done = _one_per_item(call, sent.to_dict("records"), batch_size)
            for at, (text, error) in zip(sent.index, done):
                out.at[at, "text"], out.at[at, "error"] = text, error
            yield out

    if spread_by:
        df = spread(df, spread_by, tasks)

    def param(value: Any, name: str, kind: str) -> Column:
        column = value if isinstance(value, Column) else F.lit(value)
        return column.cast(kind).alias(name)

    request = F.struct(
        chat_text(messages, generation_header=True).alias("prompt"),
        param(max_new_tokens, "max_new_tokens", "int"),
        param(temperature, "temperature", "double"),
        param(top_p, "top_p", "double"),
        param(do_sample, "do_sample", "boolean"),
    )
    text = F.when(F.col("_out.text").isNotNull(), truncate_at_stop("_out.text", stops or []))
    return (
        df.withColumn("_out", run.asNondeterministic()(request))
        .withColumn("generated", text)
        .withColumn("error", F.col("_out.error"))
        .drop("_out")
    )
