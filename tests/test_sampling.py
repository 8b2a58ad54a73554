import hashlib

import pytest

from lectern.operators import sampling


def order(n, seed=42):
    return sorted(range(n), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


def keys(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("n, train", [(0, 0), (1, 0), (19, 18), (20, 19), (21, 19), (1000, 950)])
def test_exact_split(spark, n, train):
    split = sampling.exact_split(spark.range(n), "id").collect()
    chosen = sorted(r["id"] for r in split if r["split"] == "train")
    assert len(split) == n and len(chosen) == train
    assert chosen == sorted(order(n)[:train])


@pytest.mark.parametrize("n", [0, 1, 7, 300, 1000, 5000])
@pytest.mark.parametrize("digits, more, most", [(4, 5, 1 << 24), (1, 1, 1 << 24), (1, 1, 3)])
def test_sample_is_exact_at_any_depth(spark, monkeypatch, n, digits, more, most):
    """With one digit at a time, brackets hold many keys; where that is too many, prefix after
    prefix is counted."""
    for name, value in (("DIGITS", digits), ("MORE", more), ("MOST_KEYS", most)):
        monkeypatch.setattr(sampling, name, value)
    got = keys(sampling.sample_n(spark.range(1000), n, "id", seed=7))
    assert got == sorted(order(1000, 7)[:n])


def test_shuffle_is_a_fixed_permutation(spark):
    got = [r["id"] for r in sampling.seeded_shuffle(spark.range(100), "id").collect()]
    again = [r["id"] for r in sampling.seeded_shuffle(spark.range(100), "id").collect()]
    other = [r["id"] for r in sampling.seeded_shuffle(spark.range(100), "id", 1).collect()]
    assert got == again == order(100) and sorted(other) == list(range(100)) and other != got


def test_selection_needs_no_shuffle(spark):
    split = sampling.exact_split(spark.range(100), "id")
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_samples_are_found_together_in_two_jobs(spark):
    """Whatever their number and sizes."""
    df = spark.range(20_000)
    wanted = [(5, "a"), (700, "b"), (19_999, "a"), (0, "c"), (50_000, "d")]
    counted = []
    collect = type(df).collect
    try:
        type(df).collect = lambda self: counted.append(1) or collect(self)
        chosen = sampling.samples(df, wanted, "id")
    finally:
        type(df).collect = collect
    assert len(counted) <= 2
    for condition, (n, seed) in zip(chosen, wanted):
        assert keys(df.filter(condition)) == sorted(order(20_000, seed)[:n])


def test_rows_that_share_a_key_are_taken_together(spark):
    df = spark.range(100).selectExpr("id % 10 AS id")
    got = [r["id"] for r in sampling.sample_n(df, 25, "id").collect()]
    assert len(got) == 30 and len(set(got)) == 3


def test_split_counts(spark):
    counts = sampling.split_counts(sampling.exact_split(spark.range(100), "id", 0.8))
    assert {r["split"]: r["rows"] for r in counts.collect()} == {"train": 80, "val": 20}


@pytest.mark.parametrize("n", [0, 1, 2, 5, 6, 7, 100])
def test_first_rows_of_texts_and_numbers(spark, monkeypatch, n):
    texts = ["a", "aa", "ab", "a\u00e9", "b", "\U0001f600"]
    df = spark.createDataFrame([(t, i * 10**9 - 2 * 10**9) for i, t in enumerate(texts)], "t string, i long")
    for order in ("t", "i"):
        for most in (1 << 24, 0):
            monkeypatch.setattr(sampling, "MOST_KEYS", most)
            got = sorted(r[order] for r in sampling.first_rows(df, n, order).collect())
            assert got == sorted(r[order] for r in df.collect())[:n]
    with pytest.raises(TypeError):
        sampling.first_rows(df.selectExpr("cast(i as double) x"), 1, "x")
