import pytest
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.operators import hooks
from lectern.plans import explain
from tests.conftest import chat_rows, told

RECORDS = [
    [("system", "s"), ("user", "q"), ("assistant", "hello")],
    [("user", "q"), ("assistant", "short")],
    [("user", "q"), ("assistant", "a"), ("user", "third")],
]


def marking():
    return lambda texts, source, target: [f"{target}<{t}>" for t in texts]


def test_back_translation(spark):
    got = {r["key"]: r for r in hooks.back_translate(chat_rows(spark, RECORDS), marking, 10).collect()}
    assert told(got["0"])[2] == ("assistant", "en<de<hello>>") and not got["0"]["mismatch"]
    assert told(got["1"])[1] == ("assistant", "en<de<>>") and got["1"]["mismatch"]
    assert told(got["2"])[1] == ("assistant", "en<de<third>>") and got["2"]["mismatch"]
    assert hooks.back_translate(chat_rows(spark, RECORDS), marking, 2, "fr").count() == 2


def test_failing_translations_are_dropped(spark):
    def broken():
        def translate(texts, source, target):
            if "bad" in texts:
                raise RuntimeError("no")
            return texts

        return translate

    records = [[("system", "s"), ("user", "q"), ("assistant", "bad" if i == 3 else "ok")] for i in range(12)]
    df = chat_rows(spark, records).coalesce(1)
    assert hooks.back_translate(df, broken, 12, batch_size=4, tasks=1).count() == 8

    def unloadable():
        raise RuntimeError("no model")

    assert hooks.back_translate(df, unloadable, 12).count() == 0
    assert hooks.back_translate(df, None, 12).count() == 0


def test_captions_once_per_path(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def make():
        def caption(paths):
            with open(calls, "a") as f:
                f.write("".join(p + "\n" for p in paths))
            if "bad" in paths:
                raise OSError("unreadable")
            return [f"[{p}]" for p in paths]

        return caption

    images = spark.createDataFrame(
        [("d", 1, i, p) for i, p in enumerate(["a"] * 50 + ["b", "bad", "", None])],
        "deck string, slide_number int, ordinal int, image_path string",
    )
    got = {r["ordinal"]: r["caption"] for r in hooks.caption_images(images, make).collect()}
    assert [got[0], got[49], got[50], got[51], got[52], got[53]] == ["[a]", "[a]", "[b]", fixed.NO_CAPTION, None, None]
    with open(calls) as f:
        assert set(f.read().split()) == {"a", "b", "bad"}


def test_a_second_run_asks_only_for_what_the_memo_lacks(spark, tmp_path):
    """Captions by content, whatever the path; failures are tried again."""
    calls, memo = tmp_path / "calls", str(tmp_path / "memo")

    def captioner(fails):
        name = str(calls)

        def make():
            def caption(pictures):
                with open(name, "a") as f:
                    f.write("".join(content.decode() + "\n" for _, content in pictures))
                if fails and any(content == b"bad" for _, content in pictures):
                    raise OSError("unreadable")
                return [f"[{content.decode()}]" for _, content in pictures]

            return caption

        return make

    rows = [("d", 1, "p1", "x", b"one"), ("e", 2, "p2", "x", b"one"), ("e", 3, "p3", "y", b"bad"), ("f", 1, "", None, None)]
    schema = "deck string, slide_number int, image_path string, sha1 string, content binary"
    images = spark.createDataFrame(rows, schema)

    def captions(images, fails):
        calls.write_text("")
        found = hooks.caption_images(images.drop("content"), captioner(fails), blobs=images, memo=memo, key="sha1", batch_size=1)
        return {(r["deck"], r["slide_number"]): r["caption"] for r in found.collect()}, sorted(calls.read_text().split())

    want = {("d", 1): "[one]", ("e", 2): "[one]", ("e", 3): fixed.NO_CAPTION, ("f", 1): None}
    assert captions(images, True) == (want, ["bad", "one"])
    want["e", 3] = "[bad]"
    assert captions(images, False) == (want, ["bad"])
    assert captions(images, True) == (want, [])
    more = images.unionByName(spark.createDataFrame([("g", 1, "p9", "z", b"new")], schema))
    assert captions(more, True) == (want | {("g", 1): "[new]"}, ["new"])


def test_a_worker_keeps_as_many_models_as_are_set(spark, monkeypatch):
    monkeypatch.setattr(hooks, "_models", {})
    loads = []

    def model(name):
        return hooks._model(spark, lambda: loads.append(name) or (lambda items: items))

    spark.conf.set(hooks.MODELS_KEPT, "3")
    try:
        models = [model(n) for n in range(3)]
        for _ in range(2):
            for m in models:
                m()
        assert loads == [0, 1, 2] and len(hooks._models) == 3
        models[0]()
        model(3)()  # the one used longest ago goes
        models[0]()
        assert loads == [0, 1, 2, 3]
        models[1]()
        assert loads == [0, 1, 2, 3, 1]
    finally:
        spark.conf.unset(hooks.MODELS_KEPT)


def test_captions_are_asked_for_once_each(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def make():
        with open(calls + "-loads", "a") as f:
            f.write("x")

        def caption(paths):
            with open(calls, "a") as f:
                f.write("".join(p + "\n" for p in paths))
            return paths

        return caption

    images = spark.range(400).select(
        F.lit("d").alias("deck"),
        F.lit(1).alias("slide_number"),
        F.col("id").alias("ordinal"),
        F.concat(F.lit("p"), F.pmod("id", F.lit(50)).cast("string")).alias("image_path"),
    )
    assert hooks.caption_images(images, make, tasks=40).filter("caption = image_path").count() == 400
    with open(calls) as f:
        assert sorted(f.read().split()) == sorted(f"p{i}" for i in range(50))
    with open(calls + "-loads") as f:
        assert len(f.read()) <= 8


def echo():
    def run(requests):
        if any("boom" in r["prompt"] for r in requests):
            raise ValueError("refused")
        return [f" {r['prompt'][-30:-23]}{r['max_new_tokens']} {r['temperature']} {r['do_sample']} END tail" for r in requests]

    return run


def test_generate(spark):
    df = spark.createDataFrame([(1, "x"), (2, "boom"), (3, None)], "id int, t string").coalesce(1)
    asked = df.withColumn("messages", F.when(F.col("t").isNotNull(), hooks.text_as_messages("t")))
    rows = hooks.generate(asked, echo, F.col("id") * 10, 0.5, do_sample=False, stops=["STOP", "END"])
    got = {r["id"]: (r["generated"], r["error"]) for r in rows.collect()}
    assert got[1][0].endswith("10 0.5 False") and got[1][1] is None
    assert got[2] == (None, "refused") and got[3] == (None, None)


SLIDES = "deck string, slide_number int, text_content string, tables array<array<array<string>>>, notes string"


def seen():
    return lambda requests: [r["prompt"] for r in requests]


@pytest.mark.parametrize(
    "indices, used, in_context", [(None, [0, 1], 2), ([1, 0, 9], [1, 0, 9], 2), ([9], [9], 0)]
)
def test_explain_batch(spark, indices, used, in_context):
    slides = spark.createDataFrame([("d", 1, "First", [], None), ("d", 2, "Second", [], "n")], SLIDES)
    decks = spark.createDataFrame([("d",), ("empty",)], "deck string")
    images = spark.createDataFrame([("d", 2, 0, "p")], "deck string, slide_number int, ordinal int, image_path string")
    rows = explain.explain_batch(decks, slides, seen, indices, images, lambda: lambda ps: ["cap"] * len(ps))
    got = {r["deck"]: r for r in rows.collect()}
    done = got["d"]
    assert done["slides_used"] == used and done["slides_in_context"] == in_context and done["error"] is None
    assert done["topic"] == ("First" if indices is None else "Second")
    assert ("Image: cap" in done["explanation"]) == (in_context > 0)
    assert done["metadata"]["include_images"] and done["metadata"]["max_tokens"] == 512
    empty = got["empty"]
    assert (empty["error"], empty["explanation"], empty["topic"]) == (fixed.NO_SLIDES_ERROR, "", "")


def test_explain_failure_is_a_row(spark):
    slides = spark.createDataFrame([("d", 1, "boom", [], None), ("e", 1, "fine", [], None)], SLIDES)
    rows = explain.explain_batch(slides.select("deck"), slides, echo, style="feynman")
    got = {r["deck"]: r for r in rows.collect()}
    assert got["d"]["error"] == "refused" and got["d"]["explanation"] == ""
    assert got["e"]["error"] is None and got["e"]["metadata"]["style"] == "feynman"


def test_derived_material_and_quizzes(spark):
    df = spark.createDataFrame([("1", "Tides rise. More."), ("2", "boom")], "key string, text string")
    analogies = {r["key"]: r for r in explain.derive_material(df, "analogy", echo).collect()}
    assert analogies["1"]["topic"] == "Tides rise" and "256 0.7" in analogies["1"]["analogies"]
    assert analogies["2"]["error"] == "refused" and analogies["2"]["analogies"] == ""
    assert "384" in explain.derive_material(df, "example", echo).filter("key = 1").first()["examples"]

    def quiz():
        item = '{"question": "q", "options": ["a"], "correct_index": 0, "rationale": "r"}'
        return lambda requests: [f"[{item}]" if "Tides" in r["prompt"] else "no quiz" for r in requests]

    made = {r["key"]: r for r in explain.make_quizzes(df, quiz).collect()}
    assert made["1"]["error"] is None and made["1"]["count_differs"] and len(made["1"]["items"]) == 1
    assert made["2"]["error"] == fixed.QUIZ_NOT_A_LIST and made["2"]["raw"] == "no quiz"
