"""Mixing sources to target weights by capped water-filling.

Every source has a share of all words in proportion to its weight, but never more than
``max_epochs`` times its own words; what a capped source can't take is shared again among
the others by weight, until no source is above its cap. A source's target is then met by
whole repetitions of all its documents and one fractional repetition: documents in the order
of a seeded hash until the words are reached, the last of them in part.

The place in hash order at which a source's words are reached is found by counting words per
hash prefix, then inside one prefix. So a document's share follows from its own id, size and
the row of its source: documents are never sorted or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialise

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix"
#: Hex digits of the hash by which words are first counted: of a source's documents one in
#: 4,096 is then ranked in one task, as narrow rows.
PREFIX = 3

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column | str) -> Column:
    """Words of a text, as runs other than ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(key: Column, seed: str) -> Column:
    """Hex digits of a document's place in the order of its source."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))


def water_fill(sizes: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    ``weights`` repeat over the sources by code point, null last. One row per source, so the
    windows over all of them hold no documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The sources that fill first are capped first; the level is that of the first one it
    # doesn't reach.
    filled = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("words_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn(
            "weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
        )
        .withColumn("level", F.col("words_left") / F.col("weight_left"))
        .withColumn("order", F.row_number().over(by_cap))
    )
    open_from = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("order", "level"))).over(everything)
    target = F.when(F.col("order") < F.col("open")["order"], F.col("cap").cast("double")).otherwise(
        F.least(F.col("open")["level"] * F.col("weight"), F.col("cap").cast("double"))
    )
    return filled.withColumn("open", open_from).select("source", "source_size", target.alias("target"))


def plan_mix(
    narrow: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """One row per source of ``narrow`` (``source, size, place``).

    ``source, source_size, target``; ``epochs`` whole repetitions; and of the fractional one
    ``edge``, the place up to which documents are taken whole, with the words taken
    (``edge_words``) of those held (``edge_size``) at that place.
    """
    counted = materialise(
        narrow.groupBy("source", F.substring("place", 1, PREFIX).alias("prefix")).agg(F.sum("size").alias("words")),
        "mix-prefixes",
    )
    sizes = counted.groupBy("source").agg(F.sum("words").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = (
        water_fill(sizes, weights, max_epochs)
        .withColumn("epochs", F.least(epochs, F.lit(max_epochs)).cast("long"))
        .withColumn(
            "part", F.greatest(F.floor("target") - F.col("epochs") * F.col("source_size"), F.lit(0)).cast("long")
        )
    )
    plan = materialise(plan, "mix-plan")

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    running = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    runs = counted.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    edges = (
        plan.alias("p")
        .join(runs.alias("r"), same(plan, runs))
        .filter("r.before < p.part AND p.part <= r.before + r.words")
        .select("p.source", "r.prefix", (F.col("p.part") - F.col("r.before")).alias("still"))
    )
    edges = materialise(edges, "mix-edges")
    inside = (
        narrow.alias("n")
        .join(
            edges.alias("e"),
            same(narrow, edges) & (F.substring(narrow["place"], 1, PREFIX) == edges["prefix"]),
        )
        .groupBy("n.source", "n.place", "e.still")
        .agg(F.sum("n.size").alias("edge_size"))
    )
    running = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    found = (
        inside.withColumn("edge_words", F.col("still") - F.coalesce(F.sum("edge_size").over(running), F.lit(0)))
        .filter("edge_words > 0 AND edge_words <= edge_size")
        .select(F.col("source").alias("of"), F.col("place").alias("edge"), "edge_words", "edge_size")
    )
    whole = plan.join(found, plan["source"].eqNullSafe(found["of"]), "left").drop("of")
    return materialise(whole, "mix-sources")


def words_taken(size: Column, place: Column) -> Column:
    """Words the mix takes of a document beside the row of its source."""
    part = (
        F.when(F.col("edge").isNull() | (place > F.col("edge")), F.lit(0))
        .when(place < F.col("edge"), size)
        .otherwise(F.floor(F.col("edge_words") * size / F.greatest(F.col("edge_size"), F.lit(1))))
    )
    return (F.col("epochs") * size + part).cast("long")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` per row of ``docs``.

    A null text has size 0; null is a source of its own; a source without words has target 0.
    Rows with equal ids share a place in the order: at the edge of a source's fractional
    repetition they share its words by size. Other columns of ``docs`` are left out. The
    result depends on the rows and the seed only, not on their layout.
    An empty table gives no rows.
    """
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words(text_col).alias("size"),
        seeded(F.col(id_col), seed).alias("place"),
    )
    narrow = materialise(narrow, "mix-sizes")
    plan = plan_mix(narrow, weights, max_epochs).withColumnRenamed("source", "of")
    return narrow.join(plan, narrow["source"].eqNullSafe(plan["of"]), "left").select(
        "doc_id", "source", "size", "source_size", "target",
        words_taken(F.col("size"), F.col("place")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per repetition of a document, and
    for one taken in part a row with the words from its start. Documents the mix takes no
    word of, those without words among them, go.
    """
    narrow = docs.select(
        F.col(source_col).alias("source"), n_words(text_col).alias("size"), seeded(F.col(id_col), seed).alias("place")
    )
    plan = plan_mix(materialise(narrow, "mix-sizes"), weights, max_epochs).withColumnRenamed("source", "of")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn(
        "size", n_words(F.col("row")[text_col])
    )
    rows = rows.withColumn("place", seeded(F.col("row")[id_col], seed)).join(plan, F.col("row")[source_col].eqNullSafe(plan["of"]), "left")
    taken = words_taken(F.col("size"), F.col("place"))
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    left = F.col("taken") - F.col("copy") * F.col("size")
    text = F.col("row")[text_col]
    cut = F.when(left >= F.col("size"), text).otherwise(first_words(text, left.cast("int")))
    out = (
        rows.withColumn("taken", taken)
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1)))
        .filter("taken > copy * size")
    )
    return out.select(*[cut.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def first_words(text: Column, n: Column) -> Column:
    """The start of a text up to the end of its n-th word."""
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(words, F.lit(1), F.greatest(n, F.lit(0))), "")


#: The mix of ``documents`` in SQL, for unique ids.
SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, source_size * {MAX_EPOCHS} AS cap,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight
  FROM s),
r AS (
  SELECT *, cap / weight AS ratio,
         row_number() OVER o AS place,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
           / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
f AS (SELECT min(place) AS place, arg_min(level, place) AS level FROM r WHERE level <= ratio),
t AS (
  SELECT r.source, r.source_size,
         CASE WHEN r.place < f.place THEN CAST(cap AS DOUBLE) ELSE least(f.level * weight, CAST(cap AS DOUBLE)) END AS target
  FROM r, f),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), {MAX_EPOCHS}) ELSE 0 END AS epochs
  FROM t),
c AS (
  SELECT d.*, p.source_size, p.target, p.epochs,
         greatest(CAST(floor(p.target) AS BIGINT) - p.epochs * p.source_size, 0) AS part,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, part - before)) AS BIGINT) AS taken
FROM c
"""
