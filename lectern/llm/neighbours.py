"""Approximate nearest neighbours by cross-polytope hashing.

Every table has a pseudo-rotation of its own: three rounds of random signs and a fast
Hadamard transform. A vector's bucket is the signed axis nearest to it once rotated. A query
looks in the buckets of its nearest axes in every table, and what lies there is ranked by
exact inner products, block by block.

Equal vectors are indexed once, with the smallest of their ids, so that a vector which many
rows share fills no bucket. Where norms differ, an extra coordinate brings all candidates to
the same norm, which keeps the order of inner products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialise

TABLES = 8
#: Least share of a table's buckets a query looks in, and least rows it should meet there.
PROBE_SHARE = 0.08
PROBE_ROWS = 1_200
#: Buckets of a table are searched in so many groups, each in blocks of so many rows.
GROUPS = 8
BLOCK_ROWS = 8_192
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows, without scaling."""
    n, width, half = len(x), x.shape[1], 1
    while half < width:
        pairs = x.reshape(n, -1, 2, half)
        x = np.concatenate((pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]), axis=2).reshape(n, width)
        half *= 2
    return x


class Rotations:
    """The pseudo-rotations of all tables, by seed."""

    def __init__(self, width: int, tables: int, seed: int):
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, width))

    def turned(self, x: np.ndarray, table: int) -> np.ndarray:
        for signs in self.signs[table]:
            x = hadamard(x * signs)
        return x

    def bucket(self, x: np.ndarray, table: int) -> np.ndarray:
        """The nearest signed axis: the axis, plus the width where the sign is negative."""
        turned = self.turned(x, table)
        axis = np.abs(turned).argmax(axis=1)
        return axis + np.where(np.take_along_axis(turned, axis[:, None], 1)[:, 0] < 0, x.shape[1], 0)

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """The ``n`` nearest signed axes of each row, nearest first."""
        turned = self.turned(x, table)
        return np.argsort(-np.concatenate((turned, -turned), axis=1), axis=1, kind="stable")[:, :n]


def vectors(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles; short vectors end in zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def in_order(a: np.ndarray, rows: np.ndarray, b: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Inner products of rows of ``a`` with rows of ``b``, added from the first component on, as
    the scores are. Both have a component in each row."""
    out = np.zeros(len(rows))
    for x, y in zip(a, b):
        out += x[rows] * y[places]
    return out


def highest(asked: np.ndarray, held: np.ndarray, near: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Row of ``asked``, place in ``held`` and score of the ``n`` rows nearest to each query,
    ties to the smaller id. ``near`` has their products but for rounding, and -inf for rows
    that don't count."""
    by_component = np.ascontiguousarray(asked.T), np.ascontiguousarray(held.T)

    def scored(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        return in_order(by_component[0], rows, by_component[1], places)

    # One more than asked for tells whether others are as near as the last one.
    size = near.shape[1]
    n, more = min(n, size), min(n + 1, size)
    best = np.argpartition(-near, more - 1, axis=1)[:, :more]
    values = np.take_along_axis(near, best, axis=1)
    order = np.argsort(-values, axis=1)
    best, values = (np.take_along_axis(a, order, axis=1) for a in (best, values))
    best = best[:, :n].copy()
    if more > n:
        # What rounding may have put on the wrong side of the n-th is looked at again.
        cut = values[:, n - 1]
        least = cut - 1e-9 * np.abs(asked).sum(axis=1) * np.abs(held).max(initial=0)
        for i in np.flatnonzero(np.isfinite(cut) & (values[:, n] >= least)):
            at = np.flatnonzero(near[i] >= least[i])
            best[i] = at[np.lexsort((ids[at], -scored(np.full(len(at), i), at)))][:n]
    rows, places = np.repeat(np.arange(len(asked)), n), best.ravel()
    kept = np.isfinite(near[rows, places])
    rows, places = rows[kept], places[kept]
    return rows, places, scored(rows, places)


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vec`` without vectors that are null, zero, or hold null or non-finite
    components, and without null ids. Rows with equal ids count once, with the smallest
    vector."""
    vec = F.col(vector_col)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.filter(F.col(id_col).isNotNull() & finite & F.exists(vec, lambda x: x != 0))
    return rows.groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min(vec).alias("vec"))


def nearest(
    table: DataFrame,
    queries: DataFrame,
    k: int = 20,
    tables: int = TABLES,
    probe_share: float = PROBE_SHARE,
    probe_rows: int = PROBE_ROWS,
    block_rows: int = BLOCK_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row of ``queries`` (``id_col``, ids in
    ``table``) the ``k`` rows found nearest by inner product, itself excepted; ties go to the
    smaller id. With fewer rows, all found.

    Vectors of different lengths are compared as if the shorter ended in zeros. Rows that
    ``valid_vectors`` leaves out are neither queries nor found. An empty table gives no rows.
    """
    spark = table.sparkSession
    rows = materialise(valid_vectors(table, id_col, vector_col), "vectors")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, longest, low, high = rows.agg(F.count("*"), F.max(F.size("vec")), F.min(norm), F.max(norm)).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], result)
    level = high - low > 1e-3 * high
    width = max(2, 1 << math.ceil(math.log2(longest + level)))
    probes = min(2 * width, math.ceil(2 * width * max(probe_share, probe_rows / n)))

    # Each distinct vector under its smallest id, with as many ids as an answer can hold.
    first = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    distinct = materialise(
        few.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")),
        "vectors-distinct",
    )
    asked = rows.join(queries.select(F.col(id_col).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = materialise(
        asked.join(distinct.select("vec", "rep"), "vec").select("vec_id", "rep", "vec"), "vectors-asked"
    )

    rotations = Rotations(width, tables, SEED)
    per_group = -(-2 * width // GROUPS)

    def levelled(x: np.ndarray) -> np.ndarray:
        if level:
            x = x / high
            x[:, longest] = np.sqrt(np.maximum(0.0, 1.0 - (x**2).sum(axis=1)))
        return x

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = levelled(vectors(batch.column(1), width))
            for t in range(tables):
                bucket = rotations.bucket(x, t).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), pa.array(bucket // per_group), pa.array(bucket), *batch.columns],
                    ["table", "group", "bucket", "rep", "vec"],
                )

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors(batch.column(1), width)
            for t in range(tables):
                found = rotations.probes(x, t, probes).astype(np.int32)
                for g in range(GROUPS):
                    inside = found // per_group == g
                    at = np.flatnonzero(inside.any(axis=1))
                    lists = [found[i][inside[i]].tolist() for i in at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), t, np.int32)),
                            pa.array(np.full(len(at), g, np.int32)),
                            pa.array(lists, pa.list_(pa.int32())),
                            *[c.take(pa.array(at)) for c in batch.columns],
                        ],
                        ["table", "group", "buckets", "rep", "vec"],
                    )

    element = dict(rows.dtypes)["vec"]
    index = distinct.select("rep", "vec").mapInArrow(
        indexed, f"table int, group int, bucket int, rep long, vec {element}"
    )
    looking = asked.groupBy("rep").agg(F.min("vec").alias("vec")).mapInArrow(
        probing, f"table int, group int, buckets array<int>, rep long, vec {element}"
    )
    # At most tables * GROUPS rows: into how many blocks each group's rows and queries are cut.
    # Every block of rows meets every block of queries, so no task holds more than two.
    of = ["table", "group"]
    blocks = F.ceil(F.count("*") / block_rows).cast("int")
    sizes = index.groupBy(*of).agg(blocks.alias("blocks")).join(
        looking.groupBy(*of).agg(blocks.alias("query_blocks")), of
    )
    sizes = F.broadcast(materialise(sizes, "vectors-blocks"))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def one_of(n: str) -> Column:
        return F.pmod(F.hash("rep"), F.col(n))

    cell = [*of, "block", "query_block"]
    index = index.join(sizes, of).withColumn("block", one_of("blocks")).withColumn("query_block", every("query_blocks"))
    looking = looking.join(sizes, of).withColumn("query_block", one_of("query_blocks")).withColumn("block", every("blocks"))

    def matrix(column: pd.Series) -> np.ndarray:
        out = np.zeros((len(column), width))
        for i, v in enumerate(column):
            out[i, : len(v)] = v
        return out

    # One more than asked for, since a query meets itself.
    keep = k + 1

    def search(there: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(there) or not len(wanted):
            return pd.DataFrame({"query": [], "rep": [], "near": []})
        asked, held, ids = matrix(wanted["vec"]), matrix(there["vec"]), there["rep"].to_numpy()
        open_ = np.zeros((len(wanted), 2 * width), bool)
        for i, buckets in enumerate(wanted["buckets"]):
            open_[i, buckets] = True
        bucket = there["bucket"].to_numpy()
        parts = []
        for b in np.unique(bucket):
            who, at = np.flatnonzero(open_[:, b]), np.flatnonzero(bucket == b)
            if len(who):
                rows, places, near = highest(asked[who], held[at], asked[who] @ held[at].T, ids[at], keep)
                parts.append((who[rows], at[places], near))
        if not parts:
            return pd.DataFrame({"query": [], "rep": [], "near": []})
        rows, places, near = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((ids[places], -near, rows))
        rows, places, near = rows[order], places[order], near[order]
        # A query's best over the buckets it looks in.
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < keep
        rows, places, near = rows[first], places[first], near[first]
        return pd.DataFrame({"query": wanted["rep"].to_numpy()[rows], "rep": ids[places], "near": near})

    found = (
        index.select(*cell, "bucket", "rep", "vec")
        .groupBy(*cell)
        .cogroup(looking.select(*cell, "buckets", "rep", "vec").groupBy(*cell))
        .applyInPandas(search, "query long, rep long, near double")
    )
    by_near = Window.partitionBy("query").orderBy(F.desc("near"), "rep")
    best = (
        found.groupBy("query", "rep")
        .agg(F.max("near").alias("near"))
        .withColumn("place", F.row_number().over(by_near))
        .filter(F.col("place") <= keep)
    )
    best = materialise(best.select("query", "rep"), "vectors-found")

    dot = F.aggregate(
        F.zip_with("q", "vec", lambda a, b: F.coalesce(a.cast("double") * b.cast("double"), F.lit(0.0))),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    sides = distinct.select("rep", "vec", "ids")
    one = distinct.select(F.col("rep").alias("query"), F.col("vec").alias("q"))
    scored = best.join(sides, "rep").join(one, "query").select("query", dot.alias("score"), "ids")
    answer = F.slice(
        F.sort_array(
            F.filter(
                F.flatten(
                    F.transform(
                        "hits",
                        lambda h: F.transform(h["ids"], lambda i: F.struct((-h["score"]).alias("minus"), i.alias("vec_id"))),
                    )
                ),
                lambda s: s["vec_id"] != F.col("vec_id"),
            )
        ),
        1,
        k,
    )
    hits = scored.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("hits"))
    return (
        asked.select("vec_id", F.col("rep").alias("query"))
        .join(hits, "query")
        .select(F.col("vec_id").alias("query_id"), F.posexplode(answer).alias("at", "hit"))
        .select(
            "query_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("hit")["vec_id"].alias("vec_id"),
            (-F.col("hit")["minus"]).alias("score"),
        )
    )
