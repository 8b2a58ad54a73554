import datetime as dt

from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.operators import sessions
from lectern.sources import jsonl
from lectern.streaming import streams
from tests.test_sessions import log, random_sessions


def run(query):
    query.awaitTermination()


def test_validation_stream_takes_each_line_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    good = '{"messages": [{"role": "user", "content": "é"}, {"role": "assistant", "content": "b"}]}'
    (source / "1.txt").write_text(f"{good}\n\nnot json\n", encoding="utf-8")

    def pass_over():
        run(streams.stream_validate(streams.read_lines(spark, str(source), 1), out))
        rows = spark.read.schema(streams.VALIDATED).parquet(f"{out}/rows").collect()
        kept = [r["value"] for r in rows if r["sink"] == "good"]
        return sorted(kept), sorted(r["reason"] for r in rows if r["sink"] == "rejects")

    kept, dropped = pass_over()
    assert len(kept) == 1 and "é" in kept[0] and dropped == [jsonl.BAD_JSON]
    (source / "2.txt").write_text('{"messages": []}\n[1]\n{"messages": null}\n')
    kept, dropped = pass_over()
    assert len(kept) == 1
    assert dropped == sorted([jsonl.BAD_JSON, jsonl.NOT_AN_OBJECT, fixed.NO_USER, fixed.NO_ASSISTANT, fixed.NO_MESSAGES])


def batches(df, folder, cuts):
    """``df`` as files in time order, one per stretch between cuts."""
    bounds = [dt.datetime(1990, 1, 1), *cuts, dt.datetime(2100, 1, 1)]
    for low, high in zip(bounds, bounds[1:]):
        part = df.filter((F.col("ts") >= low) & (F.col("ts") < high))
        part.coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, df, folder):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(folder)


def test_session_stream_equals_batch(spark, tmp_path):
    df = log(spark, *random_sessions())
    start = dt.datetime(2024, 1, 1)
    names = "session", "id", "action", "segment", "slide_idx", "last_explanation", "message"
    want = sorted(map(str, sessions.replay(df, 4).select(*names).collect()))
    # With few rows held, most micro-batches of a session are merged from runs in the state.
    for held in (streams.HELD_ROWS, 5):
        folder, out = str(tmp_path / f"log{held}"), str(tmp_path / f"out{held}")
        batches(df, folder, [start + dt.timedelta(minutes=m) for m in (7, 20, 90)])
        run(streams.write_sessions(streams.stream_sessions(stream_of(spark, df, folder), 4, held=held), out))
        got = spark.read.schema(streams.SESSION_OUTPUT).parquet(f"{out}/rows")
        assert sorted(map(str, got.select(*names).collect())) == want
        assert {r["sink"] for r in got.collect()} == {streams.REPLAYED}


def sinks(spark, out):
    rows = spark.read.schema(streams.SESSION_OUTPUT).parquet(f"{out}/rows").collect()
    return [{r["id"]: r for r in rows if r["sink"] == sink} for sink in (streams.REPLAYED, streams.LATE)]


def test_late_rows_come_out_as_they_came_and_idle_sessions_are_forgotten(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    hours = dt.timedelta(hours=1)
    schema = "session string, ts timestamp, id long, action string, response string"
    rows = [
        [("a", start, 1, "upload", ""), ("a", start, 2, "next", "")],
        [("b", start + 50 * hours, 3, "next", "")],
        [("b", start + 50 * hours, 4, "next", "")],
        [("a", start, 5, "next", "late"), ("c", start, 7, "explain", None), ("b", start + 50 * hours, 8, "prev", "")],
        [("a", start + 60 * hours, 6, "next", "")],
    ]
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    df = spark.createDataFrame(sum(rows, []), schema)

    def pass_over(batch):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        replayed = streams.stream_sessions(stream_of(spark, df, folder), 9, idle_ms=3_600_000)
        run(streams.write_sessions(replayed, out))

    # Each pass is a query of its own, which goes on from the state of the one before.
    for batch in rows:
        pass_over(batch)
    taken, late = sinks(spark, out)
    got = {id_: (r["segment"], r["slide_idx"]) for id_, r in taken.items()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (0, 1), 4: (0, 2), 8: (0, 1), 6: (0, 1)}
    assert {id_: (r["session"], r["ts"], r["action"], r["response"], r["segment"]) for id_, r in late.items()} == {
        5: ("a", start, "next", "late", None),
        7: ("c", start, "explain", None, None),
    }


IMAGES = "deck string, sha1 string, ts timestamp"


def images_at(spark, folder, *lists):
    for batch in lists:
        spark.createDataFrame(batch, IMAGES).coalesce(1).write.mode("append").parquet(folder)


def kept(spark, out):
    rows = spark.read.schema(IMAGES).parquet(f"{out}/rows").collect()
    return sorted(((r["deck"], r["sha1"]) for r in rows), key=str)


def test_images_once_across_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    images = [("d", "x", start), ("d", "x", start), ("e", "x", start), ("d", "y", start), ("d", None, start)]
    later = [("d", "x", start + dt.timedelta(days=9)), ("d", "z", start + dt.timedelta(days=9)), ("d", None, start)]
    folder, out = str(tmp_path / "images"), str(tmp_path / "out")
    df = spark.createDataFrame(images, IMAGES)

    def pass_over():
        run(streams.stream_image_dedup(stream_of(spark, df, folder), out))

    images_at(spark, folder, images, images[:2], later, later[:1])
    pass_over()
    want = [("d", "x"), ("d", "y"), ("d", "z"), ("d", None), ("e", "x")]
    assert kept(spark, out) == sorted(want, key=str)
    images_at(spark, folder, [*images, ("f", "x", start)])
    pass_over()
    assert kept(spark, out) == sorted([*want, ("f", "x")], key=str)


def test_a_batch_of_images_run_again_replaces_its_rows(spark, tmp_path):
    """The last batch fails after its rows were written, ahead of its commit."""
    start = dt.datetime(2024, 1, 1)
    folder, out = str(tmp_path / "images"), str(tmp_path / "out")
    df = spark.createDataFrame([("d", "x", start)], IMAGES)
    images_at(spark, folder, [("d", "x", start)], [("d", "x", start), ("d", "y", start)])
    run(streams.stream_image_dedup(stream_of(spark, df, folder), out))
    want = kept(spark, out)
    assert want == [("d", "x"), ("d", "y")]
    commits = tmp_path / "out" / "checkpoint" / "commits"
    for name in ("1", ".1.crc"):
        (commits / name).unlink()
    run(streams.stream_image_dedup(stream_of(spark, df, folder), out))
    assert kept(spark, out) == want
    ledger = spark.read.schema("deck string, sha1 string, batch long, prefix int").parquet(f"{out}/ledger")
    assert sorted((r["sha1"], r["batch"]) for r in ledger.collect()) == [("x", 0), ("y", 1)]
