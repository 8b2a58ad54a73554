"""Document fingerprints from closed syncmers, in DataFrame functions only.

Symbols are words, and all overlapping pieces of a long run without white space. A window of
symbols is a closed syncmer when its smallest symbol, by hash, lies at its first or last place.
That depends on the window alone, so the same passage gives the same anchors wherever it stands,
and an edit changes only the anchors whose windows it touches. An anchor is kept as the distance
to the anchor before it and the hash of its window, so a fingerprint also tells where its anchors
are. Texts of few symbols have fine anchors too, from short pieces of code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.frames import bind
from lectern.session import materialise

#: Symbols of a window.
WINDOW = 8
#: Longest word that is one symbol, in code points, and the pieces of longer ones.
SYMBOL = 32
PIECE = 8
#: Texts of fewer symbols than this many windows have fine anchors; the length of their pieces,
#: and the pieces of a window.
FEW = 8
FINE_PIECE = 4
FINE_WINDOW = 4
#: Code points from which on the first half of a text is sure to hold a fine anchor.
FINE_FROM = 18
#: Rows between which the next document is looked for in one group, more where there would be
#: too many groups; how often groups are cut, and how much larger they may stay.
GROUP_ROWS = 1024
MOST_GROUPS = 1 << 17
LEVELS = 6
ROOM = 4

_LOW = (1 << 32) - 1
#: Marks a fine anchor, so these are negative.
_FINE = -(1 << 63)


def runs(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def pieces(text: Column, length: int) -> Column:
    """All overlapping pieces, without those equal to the one before: a character repeated over
    and over is one piece."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{length}}}))."), F.lit(1))
    return bind(found, lambda p: F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, i - 1))))


def symbols(text: Column, longest: int = SYMBOL) -> Column:
    def cut(word: Column) -> Column:
        return F.when(F.char_length(word) <= longest, F.array(word)).otherwise(pieces(word, PIECE))

    has_long = F.coalesce(text, F.lit("")).rlike(rf"[^\x20\x09-\x0D]{{{longest + 1}}}")
    return F.when(has_long, F.flatten(F.transform(runs(text), cut))).otherwise(runs(text))


def hashes(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def closed(h: Column, window: int) -> Column:
    """The anchors of hashed symbols; fewer than a window have none."""
    n = F.size(h)
    places = F.filter(
        F.sequence(F.lit(1), F.greatest(n - (window - 1), F.lit(1))),
        lambda i: F.least(F.get(h, i - 1), F.get(h, i + (window - 2))) == F.array_min(F.slice(h, i, window)),
    )
    return F.when(n < window, F.array().cast("array<long>")).otherwise(
        bind(
            places,
            lambda p: F.transform(
                p,
                lambda i, j: packed(i - F.coalesce(F.get(p, j - 1), F.lit(0)), F.xxhash64(F.slice(h, i, window))),
            ),
        )
    )


def anchors(text: Column, window: int = WINDOW) -> Column:
    """The anchors of a text as 64-bit numbers: distance in the high half, hash in the low.

    A text of fewer than ``FEW`` windows of symbols has fine anchors behind these, as negative
    numbers. One too short for either, under ``FINE_FROM`` code points or of one character
    repeated, is one anchor as a whole; one without words has none.
    """
    none = F.array().cast("array<long>")
    spaced = F.array_join(runs(text), " ")

    def fine() -> Column:
        found = bind(hashes(pieces(spaced, FINE_PIECE)), lambda h: closed(h, FINE_WINDOW))
        marked = F.transform(found, lambda a: a.bitwiseOR(F.lit(_FINE)))
        return F.when(F.char_length(spaced) < FINE_FROM, none).otherwise(marked)

    def found(h: Column) -> Column:
        n = F.size(h)
        few = bind(
            F.concat(closed(h, window), fine()),
            lambda a: F.when(F.size(a) > 0, a).otherwise(F.array(packed(F.lit(1), F.xxhash64(spaced)))),
        )
        return F.when(n == 0, none).when(n < FEW * window, few).otherwise(closed(h, window))

    return bind(hashes(symbols(text)), found)


def packed(distance: Column, hashed: Column) -> Column:
    return F.shiftleft(distance.cast("long"), 32).bitwiseOR(hashed.bitwiseAND(F.lit(_LOW)))


def written(found: Column) -> Column:
    """A fingerprint as text: anchors in hex, in order."""
    return F.lower(F.array_join(F.transform(found, lambda a: F.hex(a)), "."))


def likeness(a: Column, b: Column) -> Column:
    """Twice the distinct anchors that both have, over those of each; 1 for two without any.
    By fine anchors where both texts have some, else by the others."""

    def has_fine(x: Column) -> Column:
        return F.coalesce(F.get(x, F.size(x) - 1) < 0, F.lit(False))

    def coarse(x: Column) -> Column:
        return F.when(has_fine(x), F.filter(x, lambda v: v >= 0)).otherwise(x)

    def share(x: Column, y: Column) -> Column:
        each = F.size(F.array_distinct(x)) + F.size(F.array_distinct(y))
        return F.when(each == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / each)

    return (
        F.when(F.size(a) + F.size(b) == 0, F.lit(1.0))
        .when(has_fine(a) & has_fine(b), share(F.filter(a, lambda v: v < 0), F.filter(b, lambda v: v < 0)))
        .otherwise(share(coarse(a), coarse(b)))
    )


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """``id_col, fingerprint, anchors`` per row; a null text counts as empty and has an empty
    fingerprint."""
    found = docs.select(F.col(id_col), F.explode(F.array(anchors(F.col(text_col), window))).alias("anchors"))
    return found.select(id_col, written(F.col("anchors")).alias("fingerprint"), "anchors")


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (``doc_id, text``) with ``tie``, a hash of the text, and ``place``, a number that
    never falls along ``doc_id`` (null last) and ``tie``."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = (0, -1) if low is None else (low, high)

    def whole(n: int) -> Column:
        return F.lit(str(n)).cast("decimal(20,0)")

    id_ = F.when(F.col("doc_id").isNull(), whole(high - low + 1)).otherwise(
        (F.col("doc_id").cast("decimal(20,0)") - whole(low)).cast("decimal(20,0)")
    )
    rows = rows.withColumn("tie", F.xxhash64("text"))
    tie = F.shiftright("tie", 32).cast("decimal(10,0)") + whole(1 << 31)
    return rows.withColumn("place", (id_ * whole(1 << 32) + tie).cast("decimal(38,0)"))


def located(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``rows`` with ``group``, that of their ``place`` after the last level."""
    rows = rows.withColumn("group", F.lit(0).cast("long"))
    for level in levels:
        rows = rows.join(level.select("group", "lo", "step", "first"), "group")
        # Rounding can put a place into the group after its own, never ahead of another's.
        within = F.floor((F.col("place") - F.col("lo")) / F.col("step")).cast("long")
        rows = rows.withColumn("group", F.col("first") + within).drop("lo", "step", "first")
    return rows


def dealt(places: DataFrame, group_rows: int) -> list[DataFrame]:
    """How rows are dealt into groups of some ``group_rows`` in the order of their places, by
    levels: a row of place p in a group goes to group ``first + (p - lo) / step``.

    A level cuts each group into equal ranges of places, as many as it has rows for. Groups
    that stay large, since places lie far apart or close together, are cut again. Levels
    have a row per group, of which there are ``MOST_GROUPS`` or so at most.
    """
    levels: list[DataFrame] = []
    in_order = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(LEVELS):
        found = located(places, levels).groupBy("group")
        found = found.agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.count("*").alias("n"))
        if not levels:
            group_rows = max(group_rows, -(-places.count() // MOST_GROUPS))
        cuts = F.when(F.col("hi") > F.col("lo"), F.ceil(F.col("n") / group_rows)).otherwise(1)
        found = found.withColumn("cuts", cuts.cast("decimal(20,0)"))
        step = F.floor((F.col("hi") - F.col("lo")) / F.col("cuts")) + 1
        first = F.coalesce(F.sum("cuts").over(in_order), F.lit(0)).cast("long")
        level = found.select("group", "lo", step.cast("decimal(38,0)").alias("step"), first.alias("first"), "n", "cuts")
        levels.append(materialise(level, "fingerprint-level"))
        if levels[-1].filter((F.col("cuts") > 1) & (F.col("n") > ROOM * group_rows)).isEmpty():
            break
    return levels


def edited_fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Fingerprints of documents and of their edited texts, whose last half is that much of
    the start of the next document by ascending id (after the last: the first).

    ``id_col`` (a whole number), ``n_chars, edited_text, anchors, edited_anchors, near_edited,
    near_next``. Null texts count as empty. Rows with equal ids follow each other by a hash of
    their texts; rows with a null id come last. Other columns are left out. An empty table
    gives no rows.

    Rows are grouped by ranges of ids and, where many share one, of hashes; each group also
    gets the first document of the next one as a guest, so that every row finds its next in
    its own group. Only rows equal in id and text are in one group however many they are.
    """
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    narrow = placed(narrow)
    places = materialise(narrow.select("place"), "fingerprint-places")
    levels = dealt(places, group_rows)
    rows = located(narrow, levels)
    # One row per group; places are ascending with the groups.
    firsts = located(places, levels).groupBy("group").agg(F.min("place").alias("place"))
    around = Window.orderBy("group")
    everything = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = F.coalesce(F.lead("place").over(around), F.first("place").over(everything))
    follows = materialise(firsts.select(F.col("group").alias("before"), follows.alias("place")), "fingerprint-groups")
    guests = narrow.join(follows, "place").select(
        "doc_id", "text", "tie", F.col("before").alias("group"), F.lit(True).alias("guest")
    )
    rows = rows.select("doc_id", "text", "tie", "group", F.lit(False).alias("guest")).unionByName(guests)
    rows = rows.repartition("group").withColumn("anchors", F.explode(F.array(anchors(F.col("text"), window))))
    order = Window.partitionBy("group").orderBy("guest", F.col("doc_id").asc_nulls_last(), "tie")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = (
        rows.withColumn("next", F.lead(F.struct("text", "anchors")).over(order))
        .filter(~F.col("guest"))
        .select(
            "doc_id",
            n.cast("long").alias("n_chars"),
            F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next")["text"], F.lit(1), half)).alias(
                "edited_text"
            ),
            "anchors",
            likeness(F.col("anchors"), F.col("next")["anchors"]).alias("near_next"),
        )
    )
    rows = rows.withColumn("edited_anchors", F.explode(F.array(anchors(F.col("edited_text"), window))))
    return rows.withColumn("near_edited", likeness(F.col("anchors"), F.col("edited_anchors"))).withColumnRenamed(
        "doc_id", id_col
    )
