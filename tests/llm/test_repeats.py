import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm.repeats import Repeats, without_repeats
from lectern.llm.suffixes import Hashes, repeated_places, sorted_suffixes
from tests.llm import brute


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abc\u00e9 ") for _ in range(n))
    base = [text(60) for _ in range(3)]
    rows = []
    for i in range(80):
        kind = rng.random()
        if kind < 0.5:
            at = rng.randint(0, 20)
            body = text(rng.randint(0, 8)) + rng.choice(base)[at : at + rng.randint(20, 60)] + text(rng.randint(0, 8))
        elif kind < 0.6:
            body = "a" * rng.randint(0, 60)
        elif kind < 0.7:
            body = "xy" * rng.randint(0, 40)
        else:
            body = text(rng.randint(0, 60))
        rows.append((i, body))
    return [*rows, rows[7], (None, rows[3][1]), (None, None), (200, "")]


def test_removal(docs):
    rows = corpus(1)
    got = without_repeats(docs(rows), 24, 10).collect()
    want = []
    for (key, text), spans in zip(rows, brute.repeats([t for _, t in rows], 24)):
        raw = (text or "").encode()
        kept = raw
        for a, b in reversed(spans):
            kept = kept[:a] + kept[b:]
        want.append(str((key, len(raw), spans, kept)))
    have = [str((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"]))) for r in got]
    assert sorted(have) == sorted(want)


@pytest.mark.parametrize("length, gram, group", [(24, 10, 2), (24, 24, 3), (9, 2, 1)])
def test_groups_that_are_split(docs, length, gram, group):
    rows = corpus(length)
    keyed = docs(rows).select(F.xxhash64("doc_id", "text").alias("key"), "text")
    found = {r["key"]: [tuple(s) for s in r["spans"]] for r in Repeats(keyed, length, gram, group).spans().collect()}
    keys = [r["key"] for r in keyed.collect()]
    assert [found.get(k, []) for k in keys] == brute.repeats([t for _, t in rows], length)


def test_whole_long_texts(docs):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    filler = "".join(rng.choice("ijklmnop ") for _ in range(300_000))
    rows = [(1, filler + passage), (2, passage), (3, "z" * 1200)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in without_repeats(docs(rows)).collect()}
    assert got == {1: [(300_000, 300_700)], 2: [(0, 700)], 3: [(0, 1200)]}


def test_empty(docs):
    assert without_repeats(docs([])).collect() == []


def test_suffix_order():
    rng = random.Random(2)
    for _ in range(100):
        raw = bytes(rng.choices(b"ab\x00\xff", k=rng.randint(1, 80)))
        symbols = np.concatenate((np.frombuffer(raw, np.uint8).astype(np.int64) + 1, np.zeros(300, np.int64)))
        order = sorted_suffixes(symbols, Hashes(symbols), np.ones(len(raw), bool), 100)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_repeated_places():
    rng = random.Random(3)
    for _ in range(100):
        depth = rng.choice([1, 3, 8, 20])
        strings = [bytes(rng.choices(b"ab", k=rng.randint(0, 60))) for _ in range(4)]
        counts = {}
        for s in strings:
            for i in range(len(s) - depth + 1):
                counts[s[i : i + depth]] = counts.get(s[i : i + depth], 0) + 1
        for s, marks in zip(strings, repeated_places(strings, depth)):
            assert marks.tolist() == [counts[s[i : i + depth]] > 1 for i in range(len(s) - depth + 1)]


def test_a_row_repeated_a_hundred_thousand_times(spark, docs):
    """Rows equal in id and text share a key: their regions are gathered once."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(60))
    hot = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(f"start {passage} end").alias("text"))
    rest = docs([(1, f"other {passage}"), (2, "nothing in common, long enough to have strings")])
    table = hot.unionByName(rest.select("doc_id", "text"))
    rows = without_repeats(table, 24, 10)
    got = {(r["doc_id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"]), r["n"]) for r in rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).collect()}
    text = "nothing in common, long enough to have strings"
    assert got == {
        (7, 70, 1, b"", 100_000),
        (1, 66, 1, b"other", 1),
        (2, len(text), 0, text.encode(), 1),
    }
