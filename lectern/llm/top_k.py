"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, in blocks. The first passes only count: each keeps,
per query, how many scores fall into each bin of a range, and the next pass looks into the bin
that holds the k-th highest one, until little lies between that bin's lower end and the top.
The last pass returns the scores from that end on, and ties are broken by id. No pass keeps
scores; what is shuffled after a pass is a few counts per query and block.

A block of rows is held as a matrix and the queries stream past it, so that a task's memory
is bounded however many queries and rows there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import discard, fresh_path

#: Components are multiplied by this and rounded down.
SCALE = 1024
BINS = 1024
#: A query's bin is narrowed until at most so many times k scores lie in it and above.
ENOUGH = 4
#: Rows of a block: a task holds one block. Queries are sent to every block, so blocks grow
#: with the table until they are as large as a task should hold.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 2_048, 65_536, 96
#: Queries scored at once against a block.
AT_ONCE = 128
#: Whole numbers up to here are exact as doubles, sums in any order included.
EXACT = 2**53
LEAST, MOST = -(2**63), 2**63 - 1


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, vec``: components times ``scale``, rounded down, as longs (beyond their range
    the nearest one). Rows with a null id or vector, or with a null or non-finite component
    are left out; rows with equal ids count once, with the smallest vector."""
    vec = F.col(vector_col)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    product = F.transform(vec, lambda x: x.cast("double") * F.lit(float(scale)))
    # Spark's floor of a double is a long, which ends at the range's ends as wanted.
    rows = table.filter(F.col(id_col).isNotNull() & vec.isNotNull() & finite)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(product, lambda x: F.floor(x)).alias("vec"))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; short vectors end in zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` and ``b``: longs where each is certain to fit a
    double's whole numbers, else Python's, kept within the range of longs."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = [max(abs(int(x.max())), abs(int(x.min()))) for x in (a, b)]
    if most[0] * most[1] * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    products = a.astype(object) @ b.astype(object).T
    return np.minimum(np.maximum(products, LEAST), MOST)


Answer = Callable[[np.ndarray, np.ndarray, list[int], list[int], np.ndarray], pa.RecordBatch]


def against_block(width: int, answer: Answer) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows ``block, query, vec_id, vec, lo, width``, sorted by block with its queries last:
    ``answer`` gets the ids of some queries, their scores against the whole block, their ranges,
    and the block's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, parts, held = None, [], [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            asked = batch.column("query").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (asked[1:] != asked[:-1])])
            for start, stop in zip(starts, np.r_[starts[1:], len(blocks)]):
                part = batch.slice(start, stop - start)
                if blocks[start] != block:
                    block, ids, parts, held = blocks[start], [], [], None
                there, vec = part.column("vec_id").to_numpy(), matrix(part.column("vec"), width)
                if not asked[start]:
                    ids.append(there)
                    parts.append(vec)
                    continue
                if held is None:
                    held = (np.concatenate(ids), np.concatenate(parts)) if ids else (there[:0], vec[:0])
                    ids, parts = [], []
                lows, widths = (part.column(c).to_pylist() for c in ("lo", "width"))
                for at in range(0, len(there), AT_ONCE):
                    to = at + AT_ONCE
                    scores = exact_products(vec[at:to], held[1])
                    yield answer(
                        there[at:to], scores, [int(x) for x in lows[at:to]], [int(x) for x in widths[at:to]], held[0]
                    )

    return run


def counted(k: int, bins: int) -> Answer:
    """Counts of the bins from the top down to the block's own k-th highest score; the k-th
    highest of all blocks can't lie lower. Scores above the range are not counted."""

    def answer(queries, scores, lows, widths, ids):
        out = [], [], []
        for query, row, lo, width in zip(queries, scores, lows, widths):
            row = row[ids != query]
            row = row[row >= lo]
            if len(row) and int(row.max()) - lo > MOST:  # the differences are no longs
                row = row.astype(object)
            places = ((row - lo) // width).astype(np.int64)
            found, counts = np.unique(places[places < bins], return_counts=True)
            found, counts = found[::-1], counts[::-1]
            ends = int(np.searchsorted(np.cumsum(counts), k)) + 1
            for values, value in zip(out, (np.full(len(found[:ends]), query), found[:ends], counts[:ends])):
                values.append(value)
        columns = [pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for v in out]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "bin", "n"])

    return answer


def chosen(k: int) -> Answer:
    """The block's scores from the lower end of the range on, its own k best at most."""

    def answer(queries, scores, lows, widths, ids):
        out = [], [], []
        for query, row, lo in zip(queries, scores, lows):
            at = np.flatnonzero((ids != query) & (row >= lo))
            if len(at) > k:
                # All that equal the k-th highest stay until their ids decide.
                at = at[row[at] >= np.partition(row[at], len(at) - k)[len(at) - k]]
                at = at[np.lexsort((ids[at], -np.unique(row[at], return_inverse=True)[1]))][:k]
            for values, value in zip(out, (np.full(len(at), query), ids[at], row[at].astype(np.int64))):
                values.append(value)
        columns = [pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for v in out]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    return answer


def narrowed(ranges: DataFrame, counts: DataFrame, k: int, bins: int) -> DataFrame:
    """The ranges after a pass: of each query the bin that holds its k-th highest score.

    ``above`` counts the scores above the range. With fewer than k rows in all, the range
    opens downwards and is done."""
    downwards = Window.partitionBy("query_id").orderBy(F.desc("bin"))
    upto = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
    upto = upto.withColumn("upto", F.sum("n").over(downwards.rowsBetween(Window.unboundedPreceding, 0)))
    joined = ranges.join(upto, "query_id", "left")
    holds = F.col("above") + F.col("upto") >= k
    first = (
        joined.groupBy("query_id", "lo", "width", "above")
        .agg(F.max_by(F.struct("bin", "n", "upto"), F.when(holds, F.col("bin"))).alias("hit"))
    )
    found = F.col("hit").isNotNull()
    bin_, n, upto_ = (F.col(f"hit.{c}") for c in ("bin", "n", "upto"))
    lo = F.col("lo") + bin_ * F.col("width")
    # One bin more than needed at most: a width of one is the end.
    width = F.greatest(F.ceil(F.col("width") / bins), F.lit(1))
    few = (F.col("above") + upto_ <= ENOUGH * k) | (F.col("width") == 1)
    whole = "decimal(38,0)"
    return first.select(
        "query_id",
        F.when(found, lo).otherwise(F.lit(LEAST)).cast(whole).alias("lo"),
        F.when(found, width).otherwise(F.lit(1)).cast(whole).alias("width"),
        F.when(found, F.col("above") + upto_ - n).otherwise(F.lit(0)).cast("long").alias("above"),
        F.when(found, few).otherwise(F.lit(True)).alias("done"),
    )


def top_k(
    table: DataFrame,
    queries: DataFrame,
    k: int = 10,
    scale: int = SCALE,
    bins: int = BINS,
    block_rows: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row of ``queries`` (``id_col``, ids in
    ``table``) the ``k`` rows with the highest inner products, itself excepted; ties go to the
    smaller id. With fewer rows, all.

    Components are whole: times ``scale``, rounded down. Products are exact; beyond the range
    of longs the nearest long stands for them. Vectors of different lengths are compared as if
    the shorter ended in zeros; empty and zero vectors take part. Rows that ``whole_vectors``
    leaves out are neither queries nor found, and extra columns are ignored. A query id without such a row,
    and an empty table, give no rows.
    """
    spark = table.sparkSession
    paths: list[str] = []

    def stage(df: DataFrame, label: str) -> DataFrame:
        paths.append(fresh_path(spark, label))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    rows = stage(whole_vectors(table, id_col, vector_col, scale), "top-rows")
    most = F.greatest(F.abs(F.array_max("vec").cast("decimal(38,0)")), F.abs(F.array_min("vec").cast("decimal(38,0)")))
    n, width, most = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(most)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)
    size = block_rows or min(MOST_BLOCK, max(LEAST_BLOCK, math.ceil(n / BLOCKS)))
    blocks = math.ceil(n / size)
    # No score lies beyond this, so the bins of the first pass cover all.
    bound = min(int(most or 0) ** 2 * width, MOST)
    first_width = (2 * bound) // bins + 1

    asked = rows.join(queries.select(F.col(id_col).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = stage(asked, "top-asked")
    ranges = asked.select(
        F.col("vec_id").alias("query_id"),
        F.lit(str(-bound)).cast("decimal(38,0)").alias("lo"),
        F.lit(str(first_width)).cast("decimal(38,0)").alias("width"),
        F.lit(0).cast("long").alias("above"),
        F.lit(False).alias("done"),
    )
    no_range = [F.lit(0).cast("decimal(38,0)").alias(c) for c in ("lo", "width")]
    placed: Column = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    there = rows.select(placed.alias("block"), F.lit(False).alias("query"), "vec_id", "vec", *no_range)

    def scored(ranges: DataFrame, answer: Answer, schema: str) -> DataFrame:
        """Every row of the table against the queries of ``ranges``."""
        looking = asked.join(ranges.withColumnRenamed("query_id", "vec_id"), "vec_id").select(
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
            F.lit(True).alias("query"), "vec_id", "vec", "lo", "width",
        )
        both = there.unionByName(looking).repartition("block").sortWithinPartitions("block", "query")
        return both.mapInArrow(against_block(width, answer), schema)

    answers = None
    while True:
        counts = scored(ranges.filter("NOT done"), counted(k, bins), "query_id long, bin long, n long")
        ranges = stage(narrowed(ranges.filter("NOT done"), counts, k, bins), "top-ranges")
        ready = ranges.filter("done").select("query_id", "lo", "width")
        answers = ready if answers is None else answers.unionByName(ready)
        if not ranges.filter("NOT done").limit(1).count():
            break

    hits = scored(answers, chosen(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = hits.withColumn("rank", place).filter(F.col("rank") <= k)
    path = fresh_path(spark, "top-found")
    best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.parquet(path)
    discard(spark, *paths)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


#: The same answers for the registered query's table in DuckDB.
SQL = f"""
WITH valid AS (
    SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT))) AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    GROUP BY vec_id
), scored AS (
    SELECT q.vec_id AS query_id, v.vec_id,
           CAST(list_sum(list_transform(list_zip(q.vec, v.vec),
               lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
    FROM valid q JOIN valid v ON v.vec_id <> q.vec_id
    WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
WHERE place <= 10
"""
