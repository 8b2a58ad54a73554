import random

import numpy as np
import pytest

from lectern.llm import shingle_join as sj
from lectern.llm.components import components
from tests.llm import brute


def answer(df):
    return [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()]


def compare(docs, rows):
    got = sorted(answer(sj.shingle_join(docs(rows))), key=str)
    want = sorted(((k, n, c) for (k, _), (n, c) in zip(rows, brute.components(rows))), key=str)
    assert got == want


def corpus(seed, n=90):
    """Near copies at every distance, passages that many share, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    passage = [word() for _ in range(30)]
    base = [[word() for _ in range(rng.randint(20, 90))] for _ in range(4)]
    texts = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = word()
        elif kind < 0.8:
            words = [word() for _ in range(rng.randint(5, 60))] + passage
        else:
            words = [word() for _ in range(rng.randint(0, 6))]
        texts.append((i, " ".join(words)))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components(docs, seed):
    compare(docs, corpus(seed))


def test_odd_rows(docs):
    long = " ".join(f"w{i % 7919}" for i in range(40_000))
    rows = [
        (5, None), (6, ""), (7, " \t\n"), (8, "One two three"), (3, "ONE  two\tthree"), (9, "one two"),
        (11, long), (10, long + " end"), (12, long), (12, long), (None, "a b c d e f"), (20, "a b c d e f"),
        (None, "alone here"), (None, None), (21, "a\u00a0b c"), (22, "a b c"), (23, "\u00c9 x"), (24, "\u00e9 x"),
        (None, " ".join("klmnopqrstuvwxyz")), (30, " ".join("klmnopqrstuvwxy")), (None, " ".join("klmnopqrstuvwxyzz")),
        (None, " ".join("0123456789")), (None, " ".join("012345678")), (6, "same id"), (6, "other text"),
    ]
    compare(docs, rows)


def test_empty_table(docs):
    assert answer(sj.shingle_join(docs([]))) == []
    assert sj.one_of_each(docs([])).count() == 0


def test_blocks_and_many_copies(docs, monkeypatch):
    monkeypatch.setattr(sj, "BLOCK", 2)
    monkeypatch.setattr(sj, "BROADCAST_BYTES", 0)
    compare(docs, corpus(7, 60))


def passages(seed, n):
    """Texts put together from a few passages, which many share, and near copies of some."""
    rng = random.Random(seed)
    parts = [" ".join(f"p{i}w{j}" for j in range(10)) for i in range(12)]
    texts = [" ".join(parts[i] for i in sorted(rng.sample(range(12), 4))) for _ in range(n)]
    texts += [t + " end" * (i % 4) for i, t in enumerate(texts[: n // 3])]
    return list(enumerate(texts))


@pytest.mark.parametrize("entries", [0, 300])
def test_entries_counted_as_rows(docs, monkeypatch, entries):
    monkeypatch.setattr(sj, "ENTRIES", entries)
    monkeypatch.setattr(sj, "NODE_TOKENS", 16)
    # Without counts tokens come by their hashes alone, so that common ones are in prefixes.
    monkeypatch.setattr(sj, "token_classes", lambda counts: np.zeros(len(counts), np.uint64))
    compare(docs, passages(5, 250))


def test_one_of_each(docs):
    rows = [(4, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (9, None), (9, None), (1, "x y"), (None, "x y")]
    kept = sj.one_of_each(docs(rows))
    assert kept.columns == docs([]).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == [
        (1, "x y"), (2, "a b c d e f g"), (9, None), (9, None),
    ]


def test_bitmaps_only_rule_out_what_cannot_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        a = np.unique(rng.choice(pool, rng.integers(1, 200)))
        b = np.unique(np.concatenate((a[: rng.integers(0, len(a) + 1)], rng.choice(pool, rng.integers(1, 60)))))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 75 * (len(a) + len(b) - common):
            assert sj.may_link_pair(len(a), sj.bitmap(a), len(b), sj.bitmap(b), 75)


def test_prefixes_of_similar_sets_meet_in_every_order():
    rng = np.random.default_rng(1)
    counts = sj.token_classes(rng.integers(0, 1000, 1 << sj.CELL_BITS))
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 120)).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 63, 3).astype(np.uint64))))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 75 * (len(a) + len(b) - common):
            for order in range(len(sj.ORDERS)):
                assert np.isin(sj.prefix(a, counts, order, 75), sj.prefix(b, counts, order, 75)).any()
            assert sj.meet(sj.other_prefixes(a, counts, 75), sj.other_prefixes(b, counts, 75))
        if not common:
            assert not sj.meet(sj.other_prefixes(a, counts, 75), sj.other_prefixes(b, counts, 75))


def test_structured_words_are_told_apart(docs):
    """Words whose polynomial hashes modulo a power of two are equal, whatever the base: they
    differ in every character."""
    rows = []
    for n in (3, 6, 7, 10, 12):
        word = "".join("ab"[i.bit_count() % 2] for i in range(1 << n))
        other = word.translate({97: "b", 98: "a"})
        rows += [word, other, word.upper(), f"{word} x", f"{other} x"]
    compare(docs, list(enumerate(rows)))


def test_word_hashes_are_those_of_the_bytes():
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 63, 64, 65, 200]))) for _ in range(4_000)]
    blob = " ".join(words).encode()
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    by_word = {}
    for word, h in zip(words, sj.word_hashes(blob, starts, ends).tolist()):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_keys_of_long_ids_are_not_sent(spark):
    keys = spark.range(20).selectExpr(f"named_struct('missing', false, 'id', repeat('x', {1 << 20}) || id, 'hash', id) AS key")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert not hinted(sj.few_keys(keys)) and hinted(sj.few_keys(keys.limit(2)))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)], "u long, v long")
    found = dict(components(edges).collect())
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}
