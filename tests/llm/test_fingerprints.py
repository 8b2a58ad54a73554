import random

from pyspark.sql import functions as F

from lectern.llm.fingerprints import (
    WINDOW,
    anchors,
    dealt,
    edited_fingerprints,
    fingerprints,
    likeness,
    located,
    placed,
    written,
)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def test_edits_and_likeness(docs):
    rng = random.Random(1)
    rows = [(i * 3, words(rng, rng.randint(0, 200))) for i in range(40)]
    rows += [(500, None), (501, ""), (502, "one"), (503, "one"), (504, "\u00e9\U0001f600x"), (-7, words(rng, 9)), (None, "last one")]
    got = {r["doc_id"]: r for r in edited_fingerprints(docs(rows), group_rows=4).collect()}
    after = ordered(rows)
    for (key, text), (_, following) in zip(after, after[1:] + after[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        assert got[key]["n_chars"] == len(text)
        assert got[key]["edited_text"] == text[: len(text) - half] + following[:half]
    assert got[502]["near_next"] == 1.0 and got[500]["near_next"] == 1.0
    long = [r for k, r in got.items() if r["n_chars"] > 600]
    assert all(0.3 < r["near_edited"] < 0.75 and r["near_next"] < 0.1 for r in long)


def test_repeated_ids_and_equal_texts(docs):
    rng = random.Random(2)
    text = words(rng, 60)
    rows = [(1, text), (1, text), (2, text), (2, None), (3, text + " more")]
    got = edited_fingerprints(docs(rows)).collect()
    assert len(got) == 5
    prints = {r["fingerprint"] for r in fingerprints(docs(rows[:3])).collect()}
    assert len(prints) == 1


def test_none(docs):
    assert edited_fingerprints(docs([])).collect() == []
    alone = edited_fingerprints(docs([(4, "a b c")])).collect()
    assert [(r["edited_text"], r["near_next"]) for r in alone] == [("a ba ", 1.0)]


def test_anchors_are_closed_syncmers(spark, docs):
    rng = random.Random(3)
    parts = words(rng, 120).split()
    frame = spark.createDataFrame([(" ".join(parts),), (" ".join(parts[:3]),), (" \n",), ("y" * 100,)], "t string")
    hashes = spark.createDataFrame([(p,) for p in parts], "w string").select(F.xxhash64("w")).collect()
    h = [r[0] for r in hashes]
    want = [i for i in range(len(h) - WINDOW + 1) if min(h[i], h[i + WINDOW - 1]) == min(h[i : i + WINDOW])]
    found = [r[0] for r in frame.select(anchors(frame.t)).collect()]
    at, places = 0, []
    for a in found[0]:
        at += a >> 32
        places.append(at - 1)
    assert places == want
    assert [len(f) for f in found[1:]] == [1, 0, 1]


def test_the_same_passage_gives_the_same_anchors(spark, docs):
    rng = random.Random(4)
    passage = words(rng, 80)
    frame = spark.createDataFrame([(words(rng, 30) + " " + passage + " " + words(rng, 30),), (passage,)], "t string")
    a, b = ([x & 0xFFFFFFFF for x in r[0]] for r in frame.select(anchors(frame.t)).collect())
    assert set(b) <= set(a) and len(b) > 10


def alike(spark, pairs):
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    frame = frame.select("i", anchors(frame.a).alias("a"), anchors(frame.b).alias("b"))
    return [r[1] for r in sorted(frame.select("i", likeness(F.col("a"), F.col("b"))).collect())]


def test_shifted_texts_without_white_space(spark, docs):
    rng = random.Random(5)
    letters = ["".join(map(chr, range(0x4E00, 0x5200))), "abcdefghijABCDEFGHIJ0123456789+/", "\U0001f600\U0001f601\U0001f602a"]
    pairs = []
    for alphabet in letters:
        for n in (40, 100, 256, 3000):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            pairs += [(text, alphabet[k] * k + text) for k in (1, 3)]
    got = alike(spark, pairs)
    assert all(x > 0.6 for x in got) and all(x > 0.95 for x, (a, _) in zip(got, pairs) if len(a) == 3000)


def test_few_words_and_short_runs_keep_their_half(docs):
    rng = random.Random(6)
    rows = [(i, words(rng, n)) for i, n in enumerate(list(range(4, 21)) * 3)]
    rows += [(1000 + n, "".join(rng.choice("abcdefghij") for _ in range(n))) for n in range(24, 257, 8)]
    got = edited_fingerprints(docs(rows)).collect()
    assert len(got) == len(rows)
    assert [r["doc_id"] for r in got if not 0 < r["near_edited"] < 1] == []


def test_near_copies_over_the_bounds_of_few_symbols(spark, docs):
    rng = random.Random(7)
    pairs = []
    for n in (6, 7, 8, 30, 60, 63, 64, 65):
        text = words(rng, n)
        pairs.append((text, text + " " + words(rng, 2)))
    assert all(x > 0.5 for x in alike(spark, pairs))
    assert alike(spark, [("", words(rng, 5)), ("", None), ("y" * 100, "y" * 90)]) == [0.0, 1.0, 0.0]


def test_native(docs):
    frame = edited_fingerprints(docs([(1, "a b")])).select(written(F.col("anchors")))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def python_likeness(a, b):
    if not a and not b:
        return 1.0
    fine = [bool(x) and x[-1] < 0 for x in (a, b)]
    if all(fine):
        a, b = ({v for v in x if v < 0} for x in (a, b))
    else:
        a, b = ({v for v in x if v >= 0} if f else set(x) for x, f in zip((a, b), fine))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def test_likeness_and_next_in_plain_python(docs):
    """Far-apart ids, ids that many rows share, and null ids: groups of a few rows."""
    rng = random.Random(12)
    pool = [words(rng, rng.choice([0, 1, 5, 40, 90])) for _ in range(30)]
    nth = iter(range(10_000))
    text = lambda: f"{next(nth):x} " + " ".join(rng.sample(pool, 2)) + words(rng, 3)
    rows = [(i, text()) for i in range(60)] + [(7, text()) for _ in range(80)] + [(None, text()) for _ in range(80)]
    rows += [((p << 33) + i, text()) for p in (1, 2, 2**29) for i in range(40)] + [(-(2**63), text()), (2**63 - 1, text())]
    rng.shuffle(rows)
    got = edited_fingerprints(docs(rows), group_rows=8).collect()
    assert len(got) == len(rows)
    by_text = {r["edited_text"]: r for r in got}
    assert len(by_text) == len(rows)
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append(r)
    hashed = {t: h for t, h in docs(rows).select("text", F.xxhash64("text")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashed[r[1]]))
    anchored = dict(docs(rows).select("text", anchors(F.col("text"))).collect())
    for (id_, own), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        row = by_text[edited]
        assert row["doc_id"] == id_ and row["n_chars"] == len(own) and row["anchors"] == anchored[own]
        assert abs(row["near_next"] - python_likeness(anchored[own], anchored[after])) < 1e-12
        assert abs(row["near_edited"] - python_likeness(anchored[own], row["edited_anchors"])) < 1e-12


def test_groups_are_even_wherever_ids_lie(spark):
    kinds = {
        "dense": "id",
        "in clusters": "(id % 4) * 8589934592 + id",
        "one far off": "if(id = 0, 9000000000000000000, id)",
        "one id for a third": "if(id % 3 = 0, 5, id)",
        "no id for a third": "if(id % 3 = 0, null, id)",
        "at both ends": "if(id % 2 = 0, -9223372036854775808, 9223372036854775807 - id)",
    }
    for kind, id_ in kinds.items():
        rows = placed(spark.range(20_000).selectExpr(f"cast({id_} as bigint) AS doc_id", "cast(id as string) AS text"))
        levels = dealt(rows.select("place"), 500)
        sizes = [r["count"] for r in located(rows, levels).groupBy("group").count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) <= 2_000, kind
        ends = located(rows, levels).groupBy("group").agg(F.min("place").alias("a"), F.max("place").alias("b"))
        ends = sorted(ends.collect(), key=lambda r: r["group"])
        assert all(x["b"] < y["a"] for x, y in zip(ends, ends[1:])), kind
