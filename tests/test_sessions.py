import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.operators import ordered, sessions

LOG = "session string, ts timestamp, id long, action string, response string"
START = dt.datetime(2024, 1, 1)


def log(spark, *per_session):
    """Lists of actions; the response of an action is its place."""
    rows = [
        (f"s{s}", START + dt.timedelta(minutes=i), 1000 * s + i, action, f"r{i}")
        for s, actions in enumerate(per_session)
        for i, action in enumerate(actions)
    ]
    return spark.createDataFrame(rows, LOG)


def replay(actions, total):
    """The rules, one action at a time."""
    segment, index, last, history, out = 0, 0, "", [], []
    for i, action in enumerate(actions):
        message, seen = None, last
        if action == "upload":
            segment, index, last, history = segment + 1, 0, "", []
        elif total <= 0:
            index = 0
        elif action == "next":
            index = min(total - 1, index + 1)
        elif action == "prev":
            index = max(0, index - 1)
        if action == "explain":
            if segment:
                last = f"r{i}"
            else:
                message = fixed.UPLOAD_FIRST
        if action in sessions.FOLLOW_UPS and not last:
            message = fixed.EXPLAIN_FIRST
        if action in fixed.ACTION_LABELS:
            label = fixed.ACTION_LABELS[action]
            if action == "explain" and not message:
                label += f" slides [{index}]"
            history.append((segment, len(history) + 1, label, message or f"r{i}"))
        out.append((action, segment, index, seen, message, history[-1] if action in fixed.ACTION_LABELS else None))
    return out


ACTIONS = ["upload", "explain", "next", "prev", "analogy", "example", "quiz"]
WEIGHTS = [1, 3, 8, 8, 3, 3, 3]


def random_sessions():
    rng = random.Random(11)
    long = rng.choices(ACTIONS, [0.05, *WEIGHTS[1:]], k=400)
    return [long, *(rng.choices(ACTIONS, WEIGHTS, k=rng.randint(1, 40)) for _ in range(15))]


@pytest.mark.parametrize("total", [0, 1, 4])
@pytest.mark.parametrize("seconds", [sessions.CHUNK_SECONDS, 600])
def test_replay_against_the_rules(spark, total, seconds):
    """In chunks of ten minutes sessions are cut."""
    logs = random_sessions()
    df = log(spark, *logs)
    got = sessions.replay(df, total, seconds).orderBy("session", "id").collect()
    names = "action", "segment", "slide_idx", "last_explanation", "message"
    want = [
        (f"s{s}", *step[:5])
        for s in sorted(range(len(logs)), key=lambda s: f"s{s}")
        for step in replay(logs[s], total)
    ]
    assert [(r["session"], *(r[n] for n in names)) for r in got] == want
    history = sessions.chat_history(df, total, seconds).collect()
    entries = sorted((f"s{s}", *step[5]) for s in range(len(logs)) for step in replay(logs[s], total) if step[5])
    assert sorted(map(tuple, history)) == entries


def test_navigation_stays_in_the_deck(spark):
    df = log(spark, ["prev", "next", "next", "next", "next", "prev", "upload", "prev"])
    got = [r["slide_idx"] for r in sessions.navigate(df, 3).orderBy("id").collect()]
    assert got == [0, 1, 2, 2, 2, 1, 0, 0]
    total = F.when(F.col("session") == "s0", 2).otherwise(0)
    assert [r["slide_idx"] for r in sessions.navigate(df, total).orderBy("id").collect()][:4] == [0, 1, 1, 1]


def test_gates(spark):
    df = log(spark, ["quiz", "explain", "upload", "analogy", "explain", "quiz", "upload", "example"])
    got = [r["message"] for r in sessions.gate_actions(df).orderBy("id").collect()]
    assert got == [
        fixed.EXPLAIN_FIRST,
        fixed.UPLOAD_FIRST,
        None,
        fixed.EXPLAIN_FIRST,
        None,
        None,
        None,
        fixed.EXPLAIN_FIRST,
    ]


def test_a_large_session_is_cut_by_time(spark):
    df = log(spark, ["next", "prev"] * 500, *[["next"] * 10] * 30)
    rows = ordered.ordered(df, ["session"], ["ts", "id"], F.floor(F.unix_seconds("ts") / 3600))
    chunks = rows.df.groupBy("session", "chunk").count().collect()
    assert max(r["count"] for r in chunks) <= 60 and len([r for r in chunks if r["session"] == "s0"]) >= 16


def test_empty_log(spark):
    empty = log(spark, ["next"]).limit(0)
    assert sessions.replay(empty, 5).count() == 0 and sessions.chat_history(empty, 5).count() == 0


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_replay_stays_in_the_jvm_and_shuffles_rows_once(spark):
    """Responses pass one exchange; what else is shuffled is steps and one row per chunk."""
    df = log(spark, *random_sessions())
    for frame in (sessions.navigate(df, 4), sessions.replay(df, 4), sessions.chat_history(df, 4)):
        plan = physical(frame)
        assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
    for frame in (sessions.replay(df, 4), sessions.chat_history(df, 4)):
        formatted = frame._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
        nodes = [n for n in formatted.split("\n\n") if ") Exchange\n" in n]
        inputs = [n.split("Input [")[1].split("\n")[0] for n in nodes]
        assert sum(" response#" in f", {i}" for i in inputs) == 1, inputs


def test_blocks_of_blocks(spark, monkeypatch):
    """A chunk of many blocks, which are folded in blocks again."""
    monkeypatch.setattr(ordered, "BLOCK", 4)
    logs = random_sessions()
    df = log(spark, *logs)
    got = sessions.replay(df, 5).orderBy("session", "id").collect()
    want = [(f"s{s}", step[2]) for s in sorted(range(len(logs)), key=lambda s: f"s{s}") for step in replay(logs[s], 5)]
    assert [(r["session"], r["slide_idx"]) for r in got] == want
