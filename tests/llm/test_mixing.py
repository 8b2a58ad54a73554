import duckdb
import pytest

from lectern.llm import mixing
from tests.llm import brute


def words(n, w="w"):
    return " ".join([w] * n)


def sizes_of(rows):
    out = {}
    for r in rows:
        out[r[2]] = out.get(r[2], 0) + len((r[1] or "").encode().split())
    return out


ROWS = [(i, words(1 + i * 7 % 40), f"s{i % 5}") for i in range(80)] + [
    (100, words(900), "big"), (101, words(2), "tiny"), (102, None, "tiny"), (103, "", "none"), (104, words(5), None),
    (104, words(5), None), (None, words(8), "s1"), (None, None, None),
]


def test_targets_and_words(docs):
    rows = mixing.mix(docs(ROWS)).collect()
    targets = brute.water_fill(sizes_of(ROWS), (5, 2, 1), 3)
    assert len(rows) == len(ROWS)
    taken = {}
    for r in rows:
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 2
    assert sum(targets.values()) == pytest.approx(sum(sizes_of(ROWS).values()))


def test_layout_does_not_matter(docs):
    one = mixing.mix(docs(ROWS).repartition(7)).collect()
    other = mixing.mix(docs(ROWS).coalesce(1)).collect()
    assert sorted(map(str, one)) == sorted(map(str, other))


def test_sql(docs):
    rows = [r for r in ROWS if r[0] is not None and r[0] != 104]
    frame = docs(rows)
    con = duckdb.connect()
    con.register("documents", frame.select("doc_id", "text", "source").toPandas())
    want = sorted(map(str, con.sql(mixing.SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in mixing.mix(frame).collect()) == want


def test_empty_tables(docs):
    assert mixing.mix(docs([])).collect() == []
    assert mixing.mixed_documents(docs([])).collect() == []
    nothing = mixing.mix(docs([(1, None, "a"), (2, "", None)])).collect()
    assert [(r["target"], r["taken"]) for r in nothing] == [(0.0, 0), (0.0, 0)]


def test_documents_of_the_mix(docs):
    frame = docs(ROWS)
    taken = {}
    for r in mixing.mix(frame).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    out = {}
    for r in mixed.collect():
        out[r["source"]] = out.get(r["source"], 0) + len(r["text"].split())
    assert out == {s: n for s, n in taken.items() if n}


def test_first_words(spark):
    row = spark.createDataFrame([("  a\tb\n c \u00a0d ",)], "t string")
    cut = lambda n: row.select(mixing.first_words(row.t, mixing.F.lit(n))).first()[0]
    assert [cut(n) for n in (0, 1, 2, 9)] == ["", "  a", "  a\tb", "  a\tb\n c \u00a0d"]
