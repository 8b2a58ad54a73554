"""Deck corpus: slide text, tables, notes, images and summaries.

A slide is one row with its shapes, tables and pictures nested in it (as they are in the
file), so reading a slide needs no grouping. Slides are numbered 1..n within a deck.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.pictures import picture_size
from lectern.functions.text import clean_text, is_deck, or_empty, preview
from lectern.operators.skew import join_per_key

SLIDE = "deck", "slide_number", "text_content", "tables", "notes", "shape_details"


def only_decks(df: DataFrame, path: str = "path") -> DataFrame:
    return df.filter(is_deck(path))


def _shape_text(shape: Column) -> Column:
    paragraphs = F.transform(shape["paragraphs"], lambda runs: F.array_join(runs, ""))
    return F.array_join(paragraphs, "\n")


def slide_text(slides: DataFrame) -> DataFrame:
    """``text_content``: runs joined per paragraph, paragraphs per shape, shapes that hold
    text per slide; "" for a slide without text."""
    texts = F.filter(F.transform("shapes", _shape_text), lambda t: t != "")
    return slides.withColumn("text_content", clean_text(F.array_join(texts, "\n")))


def slide_tables(slides: DataFrame) -> DataFrame:
    """``tables`` as a matrix of texts per table; an empty cell is ""."""
    tables = F.transform("tables", lambda t: F.transform(t, lambda r: F.transform(r, or_empty)))
    none = F.array().cast("array<array<array<string>>>")
    return slides.withColumn("tables", F.coalesce(tables, none))


def slide_notes(slides: DataFrame) -> DataFrame:
    """``notes``: null when there are none or they are empty."""
    return slides.withColumn("notes", F.nullif(F.col("notes"), F.lit("")))


def shape_details(slides: DataFrame) -> DataFrame:
    """``shape_details``: name, text and type of every text shape, in order."""
    details = F.transform(
        "shapes",
        lambda s: F.struct(
            s["shape_name"].alias("shape_name"),
            _shape_text(s).alias("text"),
            s["shape_type"].alias("shape_type"),
        ),
    )
    return slides.withColumn("shape_details", details)


def shape_rows(slides: DataFrame) -> DataFrame:
    """One row per text shape, in document order: ``ordinal``, name, type, text."""
    shapes = slides.select("deck", "slide_number", F.posexplode("shapes").alias("ordinal", "s"))
    return shapes.select(
        "deck",
        "slide_number",
        "ordinal",
        "s.shape_name",
        "s.shape_type",
        _shape_text(F.col("s")).alias("text"),
    )


def finish_slides(rows: DataFrame) -> DataFrame:
    """Deck rows as slides: number, text, tables, notes, shape details."""
    return _finished(rows).select(*SLIDE)


def slides_with_images(rows: DataFrame) -> DataFrame:
    """Finished slides with ``images``, the list of their pictures' path, format, hash, name
    and dimensions; [] without any. The pictures are in the slide's row, so nothing is joined."""
    images = F.transform(
        "pictures",
        lambda p: F.struct(
            p["image_path"].alias("image_path"),
            p["image_format"].alias("image_format"),
            p["sha1"].alias("sha1"),
            p["shape_name"].alias("shape_name"),
            _size(p["width"], p["height"]).alias("dimensions"),
        ),
    )
    return _finished(rows).select(*SLIDE, images.alias("images"))


def _finished(rows: DataFrame) -> DataFrame:
    slides = rows.filter(F.col("slide_number").isNotNull())
    return shape_details(slide_notes(slide_tables(slide_text(slides))))


def deck_images(rows: DataFrame) -> DataFrame:
    """One row per picture: ``deck, slide_number, ordinal, shape_name, image_format, sha1,
    image_path, width, height``; the bytes of the pictures are not read."""
    pictures = rows.select("deck", "slide_number", F.explode("pictures").alias("p"))
    return pictures.select("deck", "slide_number", "p.*")


def deck_blobs(rows: DataFrame) -> DataFrame:
    """One row per stored picture: ``deck, sha1, image_path, content``."""
    fields = [F.col(f"pictures.{n}").alias(n) for n in ("sha1", "image_path")]
    zipped = F.arrays_zip(*fields, F.col("blobs").alias("content"))
    return rows.select("deck", F.inline(zipped)).filter(F.col("content").isNotNull())


def with_sha1(images: DataFrame) -> DataFrame:
    return images.withColumn("sha1", F.sha1("blob"))


def _size(width: Column, height: Column) -> Column:
    return F.when(width.isNotNull(), F.struct(width.alias("width"), height.alias("height")))


def image_dimensions(images: DataFrame, content: str | None = None) -> DataFrame:
    """``dimensions`` (``width``, ``height``) of each image, from its columns of these names or
    read from a column of whole pictures; null for formats that aren't known."""
    if content is None:
        return images.withColumn("dimensions", _size(F.col("width"), F.col("height")))

    @F.arrow_udf("struct<width:int,height:int>")
    def read(blobs: pa.Array) -> pa.Array:
        sizes = [picture_size(b.as_py()) for b in blobs]
        rows = [None if s is None else {"width": s[0], "height": s[1]} for s in sizes]
        return pa.array(rows, pa.struct([("width", pa.int32()), ("height", pa.int32())]))

    return images.withColumn("dimensions", read(content))


def _stored(images: DataFrame, scope: list[str]) -> DataFrame:
    """One row per image content and scope: the path after its first occurrence."""
    first = F.min(F.struct("slide_number", "ordinal", "image_format")).alias("first")
    path = F.format_string(
        "slide%03d_%s.%s",
        F.col("first.slide_number").cast("int"),
        F.col("sha1"),
        F.col("first.image_format"),
    )
    return images.groupBy(*scope, "sha1").agg(first).select(*scope, "sha1", path.alias("image_path"), "first")


def dedup_images(images: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Every occurrence of an image, with the path of its one stored copy in the scope.

    The first occurrence per content comes from a map-side minimum, and goes back to the
    occurrences with a join that no much-copied image can overload.
    """
    scope = scope or ["deck"]
    metadata = images.drop("blob", "image_path")
    return join_per_key(metadata, _stored(metadata, scope).drop("first"), [*scope, "sha1"])


def image_blobs(images: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The stored copies: one row with path and bytes per image content and scope. The bytes
    are those of the first occurrence, which is found without them; no others are moved
    beyond the join."""
    scope = scope or ["deck"]
    first = _stored(images.drop("blob"), scope)
    place = ["slide_number", "ordinal"]
    firsts = first.select(*scope, "sha1", "image_path", *[F.col(f"first.{c}").alias(c) for c in place])
    bytes_ = images.select(*scope, "sha1", *place, F.col("blob").alias("content"))
    found = firsts.join(bytes_, [*scope, "sha1", *place]).select(*scope, "sha1", "image_path", "content")
    # Occurrences in one place of scopes wider than a deck may be several.
    return found.dropDuplicates([*scope, "sha1"])


def attach_images(slides: DataFrame, images: DataFrame) -> DataFrame:
    """Slides with their images: one row per image, and one with a null ``image`` for a slide
    without any. Rows instead of a list keep a slide with very many images spread out."""
    on = ["deck", "slide_number"]
    rest = [c for c in images.columns if c not in on]
    rows = images.select(*on, F.struct(*rest).alias("image"))
    # An inner join, of which adaptive execution splits a slide with very many images.
    merged = rows.join(slides, on)
    empty = slides.join(image_counts(images), on, "left_anti").withColumn(
        "image", F.lit(None).cast(rows.schema["image"].dataType)
    )
    columns = [*slides.columns, "image"]
    return merged.select(*columns).unionByName(empty.select(*columns))


def gallery(images: DataFrame) -> DataFrame:
    """Image paths that are not empty, placed by slide and ordinal."""
    return images.filter(F.length("image_path") > 0).select(
        "deck", "slide_number", "ordinal", "image_path"
    )


def image_counts(images: DataFrame) -> DataFrame:
    return images.groupBy("deck", "slide_number").agg(F.count("*").alias("images"))


def deck_summary(
    slides: DataFrame, images: DataFrame, decks: DataFrame | None = None
) -> DataFrame:
    """Slides, images and the status line (which counts images with a path) per deck, added
    up map-side in one grouping. ``decks`` names further decks, which may have neither."""

    def marks(df: DataFrame, **ones: Column | int) -> DataFrame:
        return df.select("deck", *[F.lit(v).cast("long").alias(n) for n, v in ones.items()])

    shown = F.coalesce(F.length("image_path") > 0, F.lit(False))
    both = marks(slides, s=1, i=0, g=0).unionByName(marks(images, s=0, i=1, g=shown))
    if decks is not None:
        both = both.unionByName(marks(decks, s=0, i=0, g=0))
    totals = both.groupBy("deck").agg(
        F.sum("s").alias("total_slides"),
        F.sum("i").alias("total_images"),
        F.sum("g").alias("_shown"),
    )
    status = F.format_string(
        "Processed %d slides. Found %d images.", F.col("total_slides"), F.col("_shown")
    )
    return totals.withColumn("status", status).drop("_shown")


def quarantine(rows: DataFrame) -> DataFrame:
    """``deck``, ``slide_number`` and ``error`` of everything that could not be read."""
    return rows.filter(F.col("error").isNotNull()).select("deck", "slide_number", "error")


def slide_card(slides: DataFrame, images: DataFrame, requests: DataFrame) -> DataFrame:
    """A markdown card for each requested ``deck`` and 0-based ``slide_idx``."""
    cards = slides.join(image_counts(images), ["deck", "slide_number"], "left").select(
        "deck",
        (F.col("slide_number") - 1).alias("slide_idx"),
        F.concat(
            F.lit("**Slide "),
            F.col("slide_number").cast("string"),
            F.lit("**\n\nText: "),
            preview("text_content", 500, fixed.NO_TEXT),
            F.lit("\n\nTables: "),
            F.coalesce(F.size("tables"), F.lit(0)).cast("string"),
            F.lit(" table(s)\n\nImages: "),
            F.coalesce("images", F.lit(0)).cast("string"),
            F.lit(" image(s)\n\nNotes: "),
            preview("notes", 200, fixed.NO_NOTES),
        ).alias("card"),
    )
    return requests.join(cards, ["deck", "slide_idx"], "left").select(
        *requests.columns, F.coalesce("card", F.lit(fixed.NO_SLIDE_CARD)).alias("card")
    )
