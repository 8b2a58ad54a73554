"""Slide decks (.pptx) as one row per slide.

A deck is a zip archive; the task that opens it, or its share of it, sees which of its pictures
are copies of earlier ones. Everything after the nested rows of a slide is relational
(``operators/decks.py``).
"""

from __future__ import annotations

import hashlib
import io
import logging
import posixpath
import zipfile
from collections.abc import Iterator
from typing import IO, Any, NamedTuple
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lectern.functions.pictures import picture_size
from lectern.operators.decks import deck_blobs, deck_images, quarantine, slides_with_images
from lectern.operators.skew import join_per_key
from lectern.schemas import DECK_ROW
from lectern.session import file_batches, fresh_path, materialise, scratch
from lectern.sources.deck_source import PIECE_BYTES, DeckSource, batches, listed, reachable

log = logging.getLogger(__name__)

# Namespaces of the file format, and image signatures by format name.
NS = {
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "p": "http://schemas.openxmlformats.org/presentationml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "rel": "http://schemas.openxmlformats.org/package/2006/relationships",
}
SIGNATURES = {"png": b"\x89PNG", "jpg": b"\xff\xd8", "gif": b"GIF8", "bmp": b"BM"}

# Larger files fit no binary column: given as content they become error rows, and pictures
# are left out.
MAX_DECK_BYTES = 2_000_000_000
MAX_PICTURE_BYTES = 1_000_000_000
LISTS = ("shapes", "tables", "pictures", "blobs")


def _name(prefix: str, local: str) -> str:
    return f"{{{NS[prefix]}}}{local}"


def _relations(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relation id to (kind, target part) of one part."""
    folder, file = posixpath.split(part)
    listing = f"{folder}/_rels/{file}.rels"
    if listing not in archive.namelist():
        return {}
    found = {}
    for node in ElementTree.fromstring(archive.read(listing)).iter(_name("rel", "Relationship")):
        target = posixpath.normpath(posixpath.join("/" + folder, node.get("Target", ""))).lstrip("/")
        found[node.get("Id")] = (node.get("Type", "").rsplit("/", 1)[-1], target)
    return found


RUN, FIELD, BREAK, TEXT = (_name("a", local) for local in ("r", "fld", "br", "t"))


def _text(run: ElementTree.Element) -> str:
    return next((node.text or "" for node in run if node.tag == TEXT), "")


def _paragraph_text(paragraph: ElementTree.Element) -> str:
    """All text of a paragraph, with a vertical tab for a line break."""
    pieces = []
    for node in paragraph:
        if node.tag == BREAK:
            pieces.append("\v")
        elif node.tag in (RUN, FIELD):
            pieces.append(_text(node))
    return "".join(pieces)


def _runs(paragraph: ElementTree.Element) -> list[str]:
    runs = [_text(node) for node in paragraph if node.tag == RUN]
    return runs or [_paragraph_text(paragraph)]


def _body_text(body: ElementTree.Element | None) -> str:
    return "" if body is None else "\n".join(map(_paragraph_text, body.findall("a:p", NS)))


def _leaves(tree: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Shapes in document order, those inside groups included."""
    for node in tree:
        if node.tag == _name("p", "grpSp"):
            yield from _leaves(node)
        else:
            yield node


def _shape_type(shape: ElementTree.Element) -> str:
    if shape.find("p:nvSpPr/p:nvPr/p:ph", NS) is not None:
        return "PLACEHOLDER (14)"
    if shape.find("p:spPr/a:custGeom", NS) is not None:
        return "FREEFORM (5)"
    locks = shape.find("p:nvSpPr/p:cNvSpPr", NS)
    if locks is not None and locks.get("txBox") in ("1", "true"):
        return "TEXT_BOX (17)"
    return "AUTO_SHAPE (1)"


def _shape_name(node: ElementTree.Element, holder: str) -> str:
    named = node.find(f"p:{holder}/p:cNvPr", NS)
    return "" if named is None else named.get("name", "")


def _picture(
    node: ElementTree.Element, relations: dict, archive: zipfile.ZipFile
) -> tuple[dict[str, Any], bytes] | None:
    """An embedded picture and its bytes; placeholders and films are none."""
    extras = node.find("p:nvPicPr/p:nvPr", NS)
    if extras is not None and any(e.tag in _NOT_PICTURES for e in extras):
        return None
    blip = node.find("p:blipFill/a:blip", NS)
    _, part = relations[blip.get(_name("r", "embed"))]
    if archive.getinfo(part).file_size > MAX_PICTURE_BYTES:
        raise ValueError(f"a picture of {archive.getinfo(part).file_size} bytes")
    blob = archive.read(part)
    by_suffix = posixpath.splitext(part)[1].lstrip(".").lower()
    known = (name for name, start in SIGNATURES.items() if blob.startswith(start))
    picture = {
        "shape_name": _shape_name(node, "nvPicPr"),
        "image_format": next(known, by_suffix),
        "sha1": hashlib.sha1(blob).hexdigest(),
        **dict(zip(("width", "height"), picture_size(blob) or (None, None))),
    }
    return picture, blob


_NOT_PICTURES = {_name("p", "ph"), _name("a", "videoFile"), _name("a", "audioFile")}


def _notes(relations: dict, archive: zipfile.ZipFile) -> str | None:
    for kind, part in relations.values():
        if kind == "notesSlide":
            for shape in ElementTree.fromstring(archive.read(part)).iter(_name("p", "sp")):
                holder = shape.find("p:nvSpPr/p:nvPr/p:ph", NS)
                if holder is not None and holder.get("type") == "body":
                    return _body_text(shape.find("p:txBody", NS))
    return None


def _slide(
    archive: zipfile.ZipFile, part: str, number: int, stored: dict[str, str]
) -> dict[str, Any]:
    """One slide; a shape that cannot be read is left out. ``stored`` has the paths of the
    pictures kept so far, by content."""
    root = ElementTree.fromstring(archive.read(part))
    relations = _relations(archive, part)
    row: dict[str, Any] = {name: [] for name in LISTS}
    for node in _leaves(root.find("p:cSld/p:spTree", NS)):
        try:
            if node.tag == _name("p", "sp"):
                paragraphs = node.findall("p:txBody/a:p", NS)
                row["shapes"].append(
                    {
                        "shape_name": _shape_name(node, "nvSpPr"),
                        "shape_type": _shape_type(node),
                        "paragraphs": [_runs(p) for p in paragraphs],
                    }
                )
            elif node.tag == _name("p", "graphicFrame"):
                for table in node.findall("a:graphic/a:graphicData/a:tbl", NS):
                    lines = table.findall("a:tr", NS)
                    cells = [line.findall("a:tc", NS) for line in lines]
                    bodies = [[cell.find("a:txBody", NS) for cell in line] for line in cells]
                    row["tables"].append([[_body_text(b) for b in line] for line in bodies])
            elif node.tag == _name("p", "pic"):
                found = _picture(node, relations, archive)
                if found:
                    picture, blob = found
                    sha1 = picture["sha1"]
                    path = f"slide{number:03d}_{sha1}.{picture['image_format']}"
                    row["blobs"].append(None if sha1 in stored else blob)
                    picture["image_path"] = stored.setdefault(sha1, path)
                    row["pictures"].append({"ordinal": len(row["pictures"]), **picture})
        except Exception as exc:
            log.warning("shape left out on %s: %s", part, exc)
    try:
        row["notes"] = _notes(relations, archive)
    except Exception as exc:
        log.warning("notes left out on %s: %s", part, exc)
    return row


def slides_of(deck: str, file: IO[bytes], nth: int = 0, of: int = 1) -> Iterator[dict[str, Any]]:
    """Slide rows of one deck, or of the ``nth`` of ``of`` shares of its slides. A slide that
    fails is empty and carries the error; a deck that cannot be opened gives an error row
    each for its text and its images, with the first share."""
    try:
        archive = zipfile.ZipFile(file)
        main = "ppt/presentation.xml"
        entries = ElementTree.fromstring(archive.read(main)).iterfind("p:sldIdLst/p:sldId", NS)
        relations = _relations(archive, main)
        parts = [relations[entry.get(_name("r", "id"))][1] for entry in entries]
    except Exception as exc:
        for reading in ("text", "image") if nth == 0 else ():
            yield {"deck": deck, "error": f"{reading}_extraction_failed: {exc}"}
        return
    stored: dict[str, str] = {}
    for number, part in enumerate(parts, start=1):
        if (number - 1) * of // len(parts) != nth:
            continue
        try:
            seen = dict(stored)
            row = _slide(archive, part, number, seen)
            stored = seen
        except Exception as exc:
            row = {**{name: [] for name in LISTS}, "error": f"slide_failed: {exc}"}
        yield {"deck": deck, "slide_number": number, **row}


def _too_large(files: DataFrame) -> DataFrame:
    """An error row each for text and images of files, whose content is not read."""
    readings = F.explode(F.array(F.lit("text"), F.lit("image"))).alias("reading")
    error = F.format_string("%s_extraction_failed: a file of %d bytes", "reading", "length")
    named = files.select("path", "length", readings).select(F.col("path").alias("deck"), error.alias("error"))
    empty = [f for f in DECK_ROW if f.name not in named.columns]
    return named.withColumns({f.name: F.lit(None).cast(f.dataType) for f in empty}).select(*DECK_ROW.names)


def parse_decks(files: DataFrame, max_bytes: int = MAX_DECK_BYTES) -> DataFrame:
    """Deck rows (``schemas.DECK_ROW``) from ``path, content``. With a column ``length``, files
    of more than ``max_bytes`` become error rows and are not opened."""

    def parse(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for path, content in zip(batch["path"], batch["content"]):
                yield from batches(slides_of(path.as_py(), io.BytesIO(content.as_py())))

    if "length" not in files.columns:
        return files.select("path", "content").mapInArrow(parse, DECK_ROW)
    small = files.filter(F.col("length") <= max_bytes).select("path", "content")
    large = _too_large(files.filter(F.col("length") > max_bytes))
    return small.mapInArrow(parse, DECK_ROW).unionByName(large)


def deck_files(spark: SparkSession, path: str) -> DataFrame:
    """The .pptx files (in any case) below a path."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[pP][pP][tT][xX]")
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def first_copies(rows: DataFrame) -> DataFrame:
    """Deck rows whose pictures were compared within shares of a deck, compared within the
    deck: each picture names the first copy, and only that one keeps its bytes."""
    at = ["slide_number", "ordinal"]
    pictures = rows.select("deck", "slide_number", F.inline("pictures")).select("deck", *at, "sha1", "image_path")
    place = F.struct(*at, "image_path")
    firsts = pictures.groupBy("deck", "sha1").agg(F.min(place).alias("first"))
    known = join_per_key(pictures.drop("image_path"), firsts, ["deck", "sha1"])
    own = (F.col("first.slide_number") == F.col("slide_number")) & (F.col("first.ordinal") == F.col("ordinal"))
    copy = F.struct("ordinal", F.col("first.image_path").alias("image_path"), own.alias("own"))
    slides = known.groupBy("deck", "slide_number").agg(F.sort_array(F.collect_list(copy)).alias("_copies"))
    named = F.zip_with("pictures", "_copies", lambda p, c: p.withField("image_path", c["image_path"]))
    kept = F.zip_with("blobs", "_copies", lambda b, c: F.when(c["own"], b))
    found = F.col("_copies").isNotNull()
    changed = {c: F.when(found, v).otherwise(F.col(c)) for c, v in (("pictures", named), ("blobs", kept))}
    return rows.join(slides, ["deck", "slide_number"], "left").withColumns(changed).select(*DECK_ROW.names)


def read_decks(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Deck rows of all decks at or below ``path``, of any size: files of more than
    ``piece_bytes`` are read in shares by several tasks, whose rows are written once, to
    compare pictures between shares.

    Where Python cannot reach the path itself (``deck_source.reachable``), Spark hands over
    whole files, and those that fit no column are error rows.
    """
    if not reachable(path):
        return parse_decks(deck_files(spark, path))
    spark.dataSource.register(DeckSource)

    def load(which: str) -> DataFrame:
        tasks = spark.sparkContext.defaultParallelism
        reader = spark.read.format("decks").option("pieceBytes", piece_bytes).option("leastPartitions", tasks)
        return reader.option("which", which).load(path)

    rows = load("whole")
    if any(f.size > piece_bytes for f in listed(path)):
        rows = rows.unionByName(first_copies(materialise(load("cut"), "deck-shares")))
    return rows


class Decks(NamedTuple):
    """Slides (their images nested), images, stored image bytes, and what failed."""

    slides: DataFrame
    images: DataFrame
    blobs: DataFrame
    errors: DataFrame


def staged_rows(rows: DataFrame, path: str | None = None) -> Decks:
    """Deck rows written once as Parquet, at ``path`` or in the shared folder, and the slides,
    images, image bytes and errors read from there (each with its own columns only)."""
    spark = rows.sparkSession
    path = path or fresh_path(spark, "decks")
    with file_batches(spark):
        rows.write.mode("overwrite").parquet(path)
    rows = spark.read.schema(DECK_ROW).parquet(path)
    return Decks(slides_with_images(rows), deck_images(rows), deck_blobs(rows), quarantine(rows))


def stage_decks(files: DataFrame, path: str | None = None) -> Decks:
    """Deck files (``path, content``) parsed once."""
    return staged_rows(parse_decks(files), path)


def ingest_decks(spark: SparkSession, source: str, path: str | None = None) -> Decks:
    """All decks below ``source``."""
    with scratch(spark):
        return staged_rows(read_decks(spark, source), path)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or path, and the path in it."""
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def export_images(blobs: DataFrame, folder: str) -> DataFrame:
    """Write stored pictures (``deck, image_path, content``) as files below ``folder``, a URI or
    path all executors reach, one folder per deck; gives ``deck, image_path, file``. A task
    that runs again writes the same files again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            files = []
            for deck, path, content in zip(*(batch.column(i) for i in range(3))):
                at = f"{root}/{hashlib.sha1(deck.as_py().encode()).hexdigest()[:16]}"
                store.create_dir(at, recursive=True)
                files.append(f"{at}/{path.as_py()}")
                with store.open_output_stream(files[-1]) as out:
                    out.write(content.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(files, pa.string())], ["deck", "image_path", "file"])

    written = blobs.select("deck", "image_path", "content").mapInArrow(write, "deck string, image_path string, file string")
    with file_batches(blobs.sparkSession):
        return materialise(written, "exported")


def stored_sizes(files: DataFrame, folder: str) -> DataFrame:
    """``file_bytes`` of each ``file`` of ``export_images`` below ``folder``, as it is stored; files
    that are gone are left out. Tasks ask the store for their own files: a listing, as Spark makes
    it to read a folder, is held by the driver with all files of it."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            found = store.get_file_info(batch.column("file").to_pylist())
            sizes = pa.array([f.size if f.is_file else None for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes], [*batch.schema.names, "file_bytes"])

    schema = StructType([*files.schema.fields, StructField("file_bytes", LongType())])
    return files.mapInArrow(look, schema).filter("file_bytes IS NOT NULL")
