import math

import numpy as np
import pytest

from lectern.llm.neighbours import Rotations, hadamard, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, vec string, bucket string"


@pytest.fixture(scope="module")
def vectors(spark, docs):
    return lambda rows: spark.createDataFrame([(i, v, None, "x", "x", "x") for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    """Exact answers; the first of rows with equal ids is the one with the smallest vector."""
    valid = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        v = [float(np.float32(x)) for x in v]
        valid[i] = min(valid.get(i, v), v)
    out = {}
    for q in queries:
        if q in valid:
            score = {i: sum(a * b for a, b in zip(valid[q], v)) for i, v in valid.items() if i != q}
            out[q] = sorted(score.items(), key=lambda s: (-s[1], s[0]))[:k]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_small_tables_are_searched_whole(vectors):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(150)]
    same = rows[5][1]
    rows += [(200 + i, same) for i in range(40)] + [(300, [2 * x for x in same]), (301, [-x for x in same])]
    rows += [(400, None), (401, [0.0] * 12), (402, [float("nan")] + [1.0] * 11), (403, [float("inf")] + [1.0] * 11)]
    rows += [(404, [None] + [1.0] * 11), (None, same), (7, rows[8][1]), (8, rows[8][1]), (405, [1.0, 2.0])]
    frame = vectors(rows)
    got = answers(nearest(frame, frame.filter("vec_id % 5 = 0"), k=20, block_rows=64))
    want = brute(rows, [i for i, _ in rows if i is not None and i % 5 == 0], 20)
    assert got.keys() == want.keys()
    for q, hits in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in hits]
        assert np.allclose([s for _, s in got[q]], [s for _, s in hits])


def test_recall_when_few_buckets_are_probed(vectors):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(3000, 32))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    frame = vectors(rows)
    got = answers(nearest(frame, frame.filter("vec_id % 50 = 0"), k=10, probe_rows=500))
    exact = points.astype(np.float32).astype(np.float64)
    scores = exact[::50] @ exact.T
    hits = total = 0
    for q, row in zip(range(0, 3000, 50), scores):
        row[q] = -2
        hits += len({i for i, _ in got[q]} & set(np.argsort(-row)[:10].tolist()))
        total += 10
    assert hits / total >= 0.9


def test_few_rows(vectors):
    empty = vectors([])
    assert nearest(empty, empty).collect() == []
    one = vectors([(0, [1.0, 2.0])])
    assert nearest(one, one).collect() == []
    two = vectors([(0, [1.0]), (20, [3.0])])
    assert answers(nearest(two, two)) == {0: [(20, 3.0)], 20: [(0, 3.0)]}


def test_rotations_keep_lengths():
    x = np.random.default_rng(2).normal(size=(5, 16))
    turned = Rotations(16, 2, 3).turned(x, 1) / 16**1.5
    assert np.allclose(np.linalg.norm(turned, axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(hadamard(hadamard(x)), 16 * x)


def test_ties_between_distinct_vectors_go_to_the_smaller_id(vectors):
    """Many vectors with one product with the query, over several blocks; sums that only the
    order of adding makes equal or not."""
    rng = np.random.default_rng(2)
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [0.5, *rng.normal(size=2).tolist()]) for i in range(1, 400)]
    rng.shuffle(rows)
    rows = [(int(i), v) for i, v in rows]
    got = answers(nearest(vectors(rows), vectors([r for r in rows if r[0] == 0]), block_rows=64))
    assert [i for i, _ in got[0]] == list(range(1, 21))
    parts = [0.1, 0.2, 0.3, 0.4, 0.7]
    rows = [(0, [1.0] * 5)] + [(i, [float(x) for x in rng.permutation(parts)]) for i in range(1, 300)]
    got = answers(nearest(vectors(rows), vectors(rows[:1]), block_rows=64))
    assert got[0] == brute(rows, [0], 20)[0]
