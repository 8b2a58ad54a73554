import math
import random

import numpy as np
import pytest

from lectern.llm.top_k import LEAST, MOST, exact_products, top_k

SCHEMA = "vec_id long, embedding array<double>, label int, query_id string, block string, lo string, n string"


@pytest.fixture(scope="module")
def vectors(spark, docs):
    return lambda rows: spark.createDataFrame([(i, v, None, "x", "x", "x", "x") for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    """Exact answers; of rows with equal ids the smallest vector counts."""
    valid = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [min(max(math.floor(x * 1024), LEAST), MOST) for x in v]
        valid[i] = min(valid.get(i, whole), whole)
    out = {}
    for q in queries:
        if q in valid:
            score = {
                i: min(max(sum(a * b for a, b in zip(valid[q], v)), LEAST), MOST) for i, v in valid.items() if i != q
            }
            best = sorted(score.items(), key=lambda s: (-s[1], s[0]))[:k]
            if best:
                out[q] = best
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def held(vectors, rows, queries, k=10, **more):
    table = vectors(rows)
    wanted = table.filter(table.vec_id.isin(queries))
    assert answers(top_k(table, wanted, k, **more)) == brute(rows, queries, k)


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_all_bins_find_the_best_of_many_blocks(vectors, bins):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(600)]
    held(vectors, rows, list(range(0, 600, 40)), bins=bins, block_rows=64)


def test_odd_rows(vectors):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [0.5, 9.0]), (1, None), (2, []), (3, [0.0, 0.0]),
        (4, [float("nan"), 1.0]), (5, [float("inf")]), (6, [None, 1.0]), (None, [1.0, 1.0]),
        (7, [-0.0001, 3.0, 5.0]), (8, [1.0]), (-100, [-1.0, -1.0]),
    ]
    held(vectors, rows, [0, 1, 2, 3, 4, 7, -100, 99])
    held(vectors, rows, [0, 7], k=2, block_rows=2)


def test_ties_go_to_the_smaller_id_across_blocks(vectors):
    """Distinct vectors of one product with the query, many more than k."""
    rows = [(0, [1.0, 0.0])] + [(i, [0.5, float(i)]) for i in range(1, 400)]
    random.Random(5).shuffle(rows)
    held(vectors, rows, [0], block_rows=50, bins=16)
    # One vector held by a third of all rows.
    rows = [(i, [0.25, 0.5] if i % 3 else [0.5, i / 900]) for i in range(900)]
    held(vectors, rows, [0, 1, 300, 899], block_rows=100)


def test_large_components_are_exact_or_end_at_the_range(vectors):
    rows = [(i, [float(2**40 + i), float(-(2**33) + 3 * i), 1.0]) for i in range(20)]
    held(vectors, rows, [0, 5], k=4)
    rows += [(100 + i, [(-1) ** i * 1e300, 1e-300 * i, float(i)]) for i in range(6)]
    held(vectors, rows, [0, 100, 101], k=8, block_rows=7)


def test_products_beyond_doubles():
    a = np.array([[2**52 + 1, 3]], np.int64)
    b = np.array([[2**10, 1], [-(2**60), 0]], np.int64)
    assert exact_products(a, b).tolist() == [[(2**52 + 1) * 2**10 + 3, LEAST]]


def test_empty_tables(vectors):
    assert answers(top_k(vectors([]), vectors([]))) == {}
    assert answers(top_k(vectors([(1, None)]), vectors([(1, None)]))) == {}
    assert answers(top_k(vectors([(1, [1.0])]), vectors([(1, [1.0])]))) == {}
    assert answers(top_k(vectors([(1, [1.0]), (2, [1.0])]), vectors([]))) == {}
