"""Concatenation, seeded order, exact samples and exact splits.

The random order of a row is ``md5(seed:key)``. ``key`` must be a unique row id, and ``df``
must give the same rows each time it is read; rows that share a key fall on the same side.
A sample or split of an exact size, or the first rows by a key, need the key at a given rank.
It is found in two jobs whatever the size, so that no step sorts the data or brings it into
one task: the first counts rows per key prefix, 65,536 counters a sample, which brackets the
rank; the second counts again inside the bracket, by a million finer prefixes, and orders the
few keys of the one that holds the rank. Samples of the same rows are found together.
Both jobs read nothing but the key and give the driver a row per sample; selecting rows is
a comparison with a constant, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_SEED = 42
#: Hex digits by which the first job counts, and further ones of the second.
DIGITS, MORE = 4, 5
#: Keys that the second job takes on; where more share a prefix, it is counted finer first.
MOST_KEYS = 1 << 24

Rank = Callable[[Column], Column]


def concat_sets(*dfs: DataFrame) -> DataFrame:
    """All rows of all sets, duplicates kept."""
    return reduce(DataFrame.unionByName, dfs)


def random_order(key: Column | str, seed: int | str = DEFAULT_SEED) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_shuffle(df: DataFrame, key: str = "key", seed: int | str = DEFAULT_SEED) -> DataFrame:
    """A permutation fixed by the seed (a range-partitioned sort)."""
    return df.orderBy(random_order(key, seed), key)


def _shared_prefix(a: str, b: str) -> str:
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[:n]


def _at_rank(counts: DataFrame, by: str, rank: Column) -> DataFrame:
    """Of each sample ``i`` the counter that holds its rank. There are few counters, so these
    windows are small whatever the data."""
    upto = Window.partitionBy("i").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = counts.select("*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(total).alias("total"))
    ranked = ranked.withColumn("rank", rank.cast("long"))
    return ranked.filter((F.col("rank") > 0) & F.col("rank").between(F.col("upto") - F.col("n") + 1, F.col("upto")))


OPEN = "i int, p string, rest long"


def _inside(keys: DataFrame, brackets: list[tuple[int, str, int]]) -> DataFrame:
    """The keys in the bracket of their sample, with its prefix and the rank within."""
    few = F.broadcast(keys.sparkSession.createDataFrame(brackets, OPEN))
    return keys.join(few, "i").filter(F.startswith("h", "p"))


def _finer(keys: DataFrame, brackets: list[tuple[int, str, int]]) -> tuple[DataFrame, DataFrame]:
    """The keys inside, with finer prefixes ``q``, and of each sample the one that holds its rank."""
    inside = _inside(keys, brackets).withColumn("q", F.left("h", F.length("p") + MORE))
    counts = inside.groupBy("i", "q").agg(F.count("*").alias("n"), F.any_value("rest").alias("rest"))
    return inside, _at_rank(counts, "q", F.col("rest"))


def _cuts(
    keys: DataFrame, ranks: list[Rank], brackets: list[tuple[int, str, int]] | None = None
) -> list[tuple[str, bool] | None]:
    """Where the first ``rank(n)`` of each sample's ``n`` keys end: keys are rows ``i, h``.

    A cut is a prefix the last of them begin with or, if the second is true, the last key
    itself. Rows with equal keys are taken together. None when the rank is 0 or above ``n``.
    ``brackets`` (sample, prefix, rank among the keys with it) spare the first job.
    """
    found: dict[int, tuple[str, bool]] = {}
    if brackets is None:
        counts = keys.groupBy("i", F.left("h", F.lit(DIGITS)).alias("p")).agg(F.count("*").alias("n"))
        rank = F.coalesce(*[F.when(F.col("i") == i, of(F.col("total"))) for i, of in enumerate(ranks)])
        hits, brackets, digits = _at_rank(counts, "p", rank).collect(), [], DIGITS
        while hits:
            large = []
            for h in hits:
                # The counter is that of a single key, or the rank falls on its end.
                single = len(h["p"]) < digits
                if single or h["upto"] == h["rank"]:
                    found[h["i"]] = h["p"], single
                    continue
                bracket = h["i"], h["p"], h["rank"] - h["upto"] + h["n"]
                (large if h["n"] > MOST_KEYS else brackets).append(bracket)
            hits = _finer(keys, large)[1].withColumnRenamed("q", "p").collect() if large else []
            digits += MORE
    if brackets:
        inside, hit = _finer(keys, brackets)
        place = (F.col("rank") - F.col("upto") + F.col("n")).alias("place")
        last = inside.select("i", "h", "q").join(F.broadcast(hit.select("i", "q", place)), ["i", "q"])
        last = last.withColumn("nth", F.row_number().over(Window.partitionBy("i").orderBy("h")))
        found |= {r["i"]: (r["h"], True) for r in last.filter("nth = place").collect()}
    return [found.get(i) for i in range(len(ranks))]


def _upto(key: Column, cut: tuple[str, bool] | None) -> Column:
    if cut is None:
        return F.lit(False)
    end, single = cut
    return key <= end if single else F.left(key, F.lit(len(end))) <= end


def _first_in_order(df: DataFrame, key: str, wanted: list[tuple[int | str, Rank]]) -> list[Column]:
    """For each (seed, rank): true for the ``rank(n)`` first rows in random order, where ``n``
    counts all rows."""
    orders = [random_order(key, seed) for seed, _ in wanted]
    keys = df.select(F.posexplode(F.array(*orders)).alias("i", "h"))
    return [_upto(order, cut) for order, cut in zip(orders, _cuts(keys, [rank for _, rank in wanted]))]


def _sortable(column: Column, kind: T.DataType) -> Column:
    """Hex digits that sort as a text (by code point), a whole number or a struct of these does;
    a text must be the last of its struct."""
    if isinstance(kind, T.StructType):
        return F.concat(*[_sortable(column[f.name], f.dataType) for f in kind])
    if isinstance(kind, T.StringType):
        return F.hex(F.encode(column, "UTF-8"))
    if isinstance(kind, T.IntegralType):
        return F.lpad(F.hex(column.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    raise TypeError(f"rows are ordered by texts or whole numbers, not {kind.simpleString()}")


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` rows by a unique column."""
    key = _sortable(F.col(order), df.schema[order].dataType)
    keys = df.select(F.lit(0).alias("i"), key.alias("h")).filter("h IS NOT NULL")
    least, most, rows = keys.agg(F.min("h"), F.max("h"), F.count("*")).first()
    if n >= rows:
        return df
    if n <= 0:
        return df.limit(0)
    # What all keys begin with brackets nothing.
    shared = len(_shared_prefix(least, most))
    keys = keys.withColumn("h", F.substr("h", F.lit(shared + 1)))
    (cut,) = _cuts(keys, [lambda _: F.lit(n)], [(0, "", n)] if rows <= MOST_KEYS else None)
    return df.filter(F.coalesce(_upto(key, (least[:shared] + cut[0], cut[1])), F.lit(False)))


def samples(df: DataFrame, wanted: list[tuple[int, int | str]], key: str = "key") -> list[Column]:
    """For each (size, seed): true for exactly ``min(size, count)`` rows, uniformly and without
    replacement. All samples are found together."""

    def rank(size: int) -> Rank:
        return lambda rows: F.least(rows, F.lit(size))

    return _first_in_order(df, key, [(seed, rank(size)) for size, seed in wanted])


def sample_n(df: DataFrame, n: int, key: str = "key", seed: int | str = DEFAULT_SEED) -> DataFrame:
    """One of ``samples``."""
    return df.filter(samples(df, [(n, seed)], key)[0])


def exact_split(
    df: DataFrame, key: str = "key", frac: float = 0.95, seed: int | str = DEFAULT_SEED
) -> DataFrame:
    """A ``split`` column: the first ``int(n * frac)`` rows in random order are "train",
    the rest are "val"."""
    (first,) = _first_in_order(df, key, [(seed, lambda rows: F.floor(rows * F.lit(float(frac))))])
    return df.withColumn("split", F.when(first, "train").otherwise("val"))


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("rows"))
