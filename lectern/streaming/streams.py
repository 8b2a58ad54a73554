"""Continuous forms of the validation, session and image operators."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from lectern.functions import fixed
from lectern.functions.frames import once
from lectern.operators.chat import violations_of
from lectern.operators.sessions import FOLLOW_UPS
from lectern.session import discard, fresh_path
from lectern.sources.jsonl import classify_lines


def read_lines(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Text files as a stream of lines; the file count bounds a micro-batch."""
    return spark.readStream.option("maxFilesPerTrigger", str(max_files)).text(path)


def judge_lines(lines: DataFrame) -> DataFrame:
    """Each non-blank line with its messages or the reasons against it: why it cannot be
    read, else the rules it breaks."""
    reasons = F.when(F.col("reason").isNotNull(), F.array("reason")).otherwise(violations_of())
    return once(classify_lines(lines), reasons=reasons)


def _to_files(df: DataFrame, path: str, checkpoint: str, *partitions: str) -> StreamingQuery:
    return (
        df.writeStream.format("parquet")
        .partitionBy(*partitions)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


VALIDATED = "value string, reason string, sink string"


def stream_validate(lines: DataFrame, out: str) -> StreamingQuery:
    """Lines judged once, into files below ``out/rows`` by ``sink``, each exactly once: "good"
    has the lines that hold a valid record, as they came; "rejects" a row per line and reason."""
    judged = judge_lines(lines)
    reasons = F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit(None)))
    rows = judged.select(F.col("line").alias("value"), F.explode(reasons).alias("reason"))
    sink = F.when(F.col("reason").isNull(), "good").otherwise("rejects")
    return _to_files(rows.withColumn("sink", sink), f"{out}/rows", f"{out}/checkpoint", "sink")


SESSION_OUTPUT = (
    "session string, ts timestamp, id long, action string, segment long, slide_idx int, "
    "last_explanation string, message string, response string, sink string"
)
LATE, REPLAYED = "late", "replayed"
SESSION_STATE = "segment long, slide_idx int, last_explanation string, until long"
#: As the processor writes it, with the time in microseconds.
SESSION_ROW = SESSION_OUTPUT.replace("ts timestamp", "at long")
Told = Row(*[c.split()[0] for c in SESSION_ROW.split(", ")])
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of one session in a micro-batch that a task holds, and rows of a piece of a run.
HELD_ROWS = 20_000
PIECE_ROWS = 1_000


def _step(action: str, response: str, total: int, state: tuple) -> tuple[tuple, tuple]:
    """New state, and the (segment, index, last explanation, message) of one action."""
    segment, index, last = state
    message, seen = None, last
    if action == "upload":
        segment, index, last = segment + 1, 0, ""
    elif action == "next":
        index = min(max(total - 1, 0), index + 1)
    elif action == "prev":
        index = max(0, index - 1)
    elif action == "explain":
        if segment:
            last = response
        else:
            message = fixed.UPLOAD_FIRST
    elif action in FOLLOW_UPS and not last:
        message = fixed.EXPLAIN_FIRST
    return (segment, index, last), (segment, index, seen, message)


class SessionProcessor(StatefulProcessor):
    """Where each session stands, and until when it is remembered.

    Rows are taken one at a time in event order. A micro-batch brings them in any order: up
    to ``held`` rows of a session are sorted in memory; of more, sorted runs wait in the state
    store, in pieces, and are merged from there.
    """

    def __init__(self, total: int, idle_ms: int, held: int = HELD_ROWS, piece: int = PIECE_ROWS):
        self.total, self.idle_ms, self.held, self.piece = total, idle_ms, held, piece

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", SESSION_STATE)
        self.runs = handle.getMapState("runs", "run long, piece long", "rows binary")

    def _put_away(self, run: int, rows: list[tuple]) -> None:
        rows.sort(key=_event_order)
        for at in range(0, len(rows), self.piece):
            self.runs.updateValue((run, at // self.piece), (pickle.dumps(rows[at : at + self.piece]),))

    def _run(self, run: int) -> Iterator[tuple]:
        """The rows of a run; its pieces are forgotten as they are read."""
        piece = 0
        while self.runs.containsKey((run, piece)):
            rows = pickle.loads(self.runs.getValue((run, piece))[0])
            self.runs.removeKey((run, piece))
            yield from rows
            piece += 1

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held: list[tuple] = []
        runs = 0
        for _, at, id_, action, response in rows:
            if watermark and at <= watermark * 1000:
                yield Told(*key, at, id_, action, None, None, None, None, response, LATE)
                continue
            held.append((at, id_, action, response or ""))
            if len(held) == self.held:
                self._put_away(runs, held)
                held, runs = [], runs + 1
        if not held and not runs:
            return
        held.sort(key=_event_order)
        was = self.state.get()
        now, until = (tuple(was[:3]), was[3]) if was else ((0, 0, ""), None)
        latest = watermark
        for at, id_, action, response in heapq.merge(held, *[self._run(n) for n in range(runs)], key=_event_order):
            now, seen = _step(action, response, self.total, now)
            latest = max(latest, at // 1000)
            yield Told(*key, at, id_, action, *seen, None, REPLAYED)
        if until is not None:
            self.handle.deleteTimer(until)
        until = latest + self.idle_ms
        self.handle.registerTimer(until)
        self.state.update((*now, until))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _event_order(row: tuple) -> tuple:
    return row[0], row[1]


def stream_sessions(
    log: DataFrame, total: int, delay: str = "1 hour", idle_ms: int = 86_400_000, held: int = HELD_ROWS
) -> DataFrame:
    """The session replay with state per session: segment, slide index, last explanation.

    ``sink`` is "replayed" for rows taken in, with the columns of the batch replay, which the
    result equals as long as micro-batches follow event time. It is "late" for rows behind the
    watermark: they come out as they came in, with their ``response`` and without a replay. A
    session idle for ``idle_ms`` of event time is forgotten, so it starts again from segment 0.

    State lies in RocksDB, which the session is set to. ``log`` needs ``session, ts, id,
    action, response``; ``ts`` and ``id`` are never null.
    """
    log.sparkSession.conf.set(STATE_STORE, ROCKS)
    # A time without the watermark's mark, so that late rows reach the processor.
    rows = log.withWatermark("ts", delay).select(
        "session", F.unix_micros("ts").alias("at"), "id", "action", "response"
    )
    replayed = rows.groupBy("session").transformWithState(
        SessionProcessor(total, idle_ms, held), SESSION_ROW, "append", "eventTime"
    )
    names = [c.split()[0] for c in SESSION_OUTPUT.split(", ")]
    return replayed.withColumn("ts", F.timestamp_micros("at")).select(*names)


def write_sessions(replayed: DataFrame, out: str) -> StreamingQuery:
    """The session stream into files below ``out/rows`` by ``sink``, each row exactly once."""
    return _to_files(replayed, f"{out}/rows", f"{out}/checkpoint", "sink")


IMAGE_KEY = ["deck", "sha1"]
#: Ledgers are laid out by so many hash prefixes; a micro-batch reads those its keys have.
PREFIXES = 64


def stream_image_dedup(images: DataFrame, out: str) -> StreamingQuery:
    """One row per deck and content hash, for good, into files below ``out/rows``, a folder per
    micro-batch.

    The keys taken so far are a ledger below ``out/ledger``, by hash prefix and batch. A
    micro-batch is reduced to one row per key, compared with the ledger's parts of its
    prefixes, and what is new is written to both. So nothing is held between batches. A batch
    that is run again after a failure looks at earlier batches only and replaces what it had
    written.
    """
    spark = images.sparkSession
    kinds = dict(images.dtypes)
    ledger = ", ".join(f"`{c}` {kinds[c]}" for c in IMAGE_KEY)
    place, rows = f"{out}/ledger", f"{out}/rows"
    empty = spark.createDataFrame([], f"{ledger}, prefix int")
    empty.write.mode("ignore").partitionBy("prefix").parquet(f"{place}/batch=-1")
    prefix = F.pmod(F.xxhash64(*IMAGE_KEY), F.lit(PREFIXES)).cast("int").alias("prefix")

    def take(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        staged = fresh_path(session, "images")
        batch.dropDuplicates(IMAGE_KEY).write.parquet(staged)
        firsts = session.read.schema(batch.schema).parquet(staged)
        wanted = [r["prefix"] for r in firsts.select(prefix).distinct().collect()]
        seen = session.read.schema(f"{ledger}, batch long, prefix int").parquet(place)
        seen = seen.filter((F.col("batch") < batch_id) & F.col("prefix").isin(wanted))
        seen = seen.select(*[F.col(c).alias(f"_seen_{c}") for c in IMAGE_KEY])
        same = [F.col(c).eqNullSafe(F.col(f"_seen_{c}")) for c in IMAGE_KEY]
        firsts.join(seen, same, "left_anti").write.mode("overwrite").parquet(f"{rows}/batch={batch_id}")
        taken = session.read.schema(batch.schema).parquet(f"{rows}/batch={batch_id}")
        keys = taken.select(*IMAGE_KEY, prefix).repartition("prefix")
        keys.write.mode("overwrite").partitionBy("prefix").parquet(f"{place}/batch={batch_id}")
        discard(session, staged)

    return (
        images.writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
