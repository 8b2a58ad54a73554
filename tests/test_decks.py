import hashlib
import io
import random
import struct
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from checks.deck_files import bmp, deck_bytes, gif, group, jpeg, picture, png, table_frame, text_box
from checks.registry import ENTRIES
from lectern.functions import fixed
from lectern.functions.pictures import picture_size
from lectern.operators import decks
from lectern.operators.decks import quarantine
from lectern.session import file_batches
from lectern.sources.deck_source import PIECE_BYTES, DeckSource, Share, dealt, joined
from lectern.sources.decks import deck_files, export_images, ingest_decks, parse_decks, read_decks, slides_of, stored_sizes

PHOTO = png(120, 60)
IMAGES = "deck string, slide_number int, ordinal int, image_path string"


def write_decks(folder):
    """A deck with groups, a table, notes and a repeated picture, an empty one, a cut one."""
    rich = deck_bytes(
        [
            {
                "shapes": [
                    text_box("Title", [["Over", "view"], ["line 2"]], '<p:ph type="title"/>'),
                    text_box("Blank", [[""]]),
                    group(text_box("Inner", [["in a group"]]), group(picture("rId7"))),
                ],
                "media": [("rId7", "image1.png", PHOTO)],
                "notes": "say hello",
            },
            {
                "shapes": [table_frame([["a", ""], ["c", "d"]]), picture("rId3"), picture("rId4"), picture("rIdNone")],
                "media": [("rId3", "image1.png", PHOTO), ("rId4", "image2.bin", gif(3, 4))],
                "notes": "",
            },
            {"shapes": []},
            "<broken",
        ]
    )
    (folder / "a.pptx").write_bytes(rich)
    (folder / "b.PPTX").write_bytes(deck_bytes([{"shapes": [text_box("T", [["b"]])]}]))
    (folder / "c.pptx").write_bytes(rich[: len(rich) // 2])
    (folder / "d.pdf").write_bytes(b"%PDF")
    return str(folder)


def by_deck(df):
    return df.withColumn("deck", F.element_at(F.split("deck", "/"), -1))


def test_read_decks(spark, tmp_path):
    rows = by_deck(read_decks(spark, write_decks(tmp_path)))
    slides = {(r["deck"], r["slide_number"]): r for r in decks.finish_slides(rows).collect()}
    assert sorted(slides) == [("a.pptx", n) for n in (1, 2, 3, 4)] + [("b.PPTX", 1)]
    first = slides["a.pptx", 1]
    assert first["text_content"] == "Overview\nline 2\nin a group"
    assert first["notes"] == "say hello" and first["tables"] == []
    assert [tuple(d) for d in first["shape_details"]] == [
        ("Title", "Overview\nline 2", "PLACEHOLDER (14)"),
        ("Blank", "", "TEXT_BOX (17)"),
        ("Inner", "in a group", "TEXT_BOX (17)"),
    ]
    assert slides["a.pptx", 2]["tables"] == [[["a", ""], ["c", "d"]]]
    assert slides["a.pptx", 2]["notes"] is None
    for n in (3, 4):
        assert slides["a.pptx", n]["text_content"] == "" and slides["a.pptx", n]["tables"] == []


def test_bad_decks_go_to_quarantine(spark, tmp_path):
    rows = by_deck(read_decks(spark, write_decks(tmp_path)))
    errors = sorted((r["deck"], r["slide_number"], r["error"].split(":")[0]) for r in decks.quarantine(rows).collect())
    assert errors == [
        ("a.pptx", 4, "slide_failed"),
        ("c.pptx", None, "image_extraction_failed"),
        ("c.pptx", None, "text_extraction_failed"),
    ]


def test_images_are_stored_once_per_deck(spark, tmp_path):
    staged = ingest_decks(spark, write_decks(tmp_path), str(tmp_path / "stage"))
    images = by_deck(staged.images)
    sha = hashlib.sha1(PHOTO).hexdigest()
    found = decks.image_dimensions(images).orderBy("slide_number", "ordinal").collect()
    assert [(r["slide_number"], r["image_format"], r["dimensions"]) for r in found] == [
        (1, "png", (120, 60)),
        (2, "png", (120, 60)),
        (2, "gif", (3, 4)),
    ]
    assert [r["image_path"] for r in found][:2] == [f"slide001_{sha}.png"] * 2
    again = decks.dedup_images(images).orderBy("slide_number", "ordinal").collect()
    assert [r["image_path"] for r in again] == [r["image_path"] for r in found]
    stored = {r["sha1"]: r for r in staged.blobs.collect()}
    assert len(stored) == 2 == staged.blobs.count()
    assert bytes(stored[sha]["content"]) == PHOTO and stored[sha]["image_path"] == f"slide001_{sha}.png"
    nested = {r["slide_number"]: r["images"] for r in by_deck(staged.slides).filter("deck = 'a.pptx'").collect()}
    assert {n: len(i) for n, i in nested.items()} == {1: 1, 2: 2, 3: 0, 4: 0}
    assert nested[2][0]["image_path"] == f"slide001_{sha}.png" and nested[2][1]["dimensions"] == (3, 4)


def test_image_blobs_keeps_one_copy(spark):
    rows = [("d", 2, 0, "png", bytearray(b"x")), ("d", 1, 0, "png", bytearray(b"x")), ("e", 3, 0, "gif", bytearray(b"x"))]
    images = decks.with_sha1(spark.createDataFrame(rows, "deck string, slide_number int, ordinal int, image_format string, blob binary"))
    sha = hashlib.sha1(b"x").hexdigest()
    got = sorted((r["deck"], r["image_path"], bytes(r["content"])) for r in decks.image_blobs(images).collect())
    assert got == [("d", f"slide001_{sha}.png", b"x"), ("e", f"slide003_{sha}.gif", b"x")]


def test_only_the_columns_in_use_are_read(spark, tmp_path):
    staged = ingest_decks(spark, write_decks(tmp_path), str(tmp_path / "stage"))

    def read(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan[plan.index("Scan") :]

    for df in (decks.image_dimensions(staged.images), staged.slides, staged.errors):
        assert "blob" not in read(df)
    texts = staged.slides.select("deck", "text_content")
    assert "pictures" not in read(texts) and "shapes" not in read(staged.images)
    for df in (staged.slides, staged.images, staged.blobs):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_deck_without_slides(spark):
    files = spark.createDataFrame([("none.pptx", bytearray(deck_bytes([])))], "path string, content binary")
    assert parse_decks(files).count() == 0


def test_unreadable_formats_have_no_dimensions(spark):
    images = spark.createDataFrame([(bytearray(b"\xd7\xcd\xc6\x9a"),), (bytearray(PHOTO[:20]),), (None,)], "blob binary")
    assert [r["dimensions"] for r in decks.image_dimensions(images, "blob").collect()] == [None] * 3


def test_attach_summary_and_gallery(spark):
    slides = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y"), ("e", 1, "z")], "deck string, slide_number int, text_content string")
    images = spark.createDataFrame([("d", 2, 0, "p"), ("d", 2, 1, ""), ("f", 1, 0, "q")], IMAGES)
    merged = decks.attach_images(slides, images).collect()
    assert sorted((r["deck"], r["slide_number"], r["image"] and r["image"]["image_path"]) for r in merged if r["image"]) == [
        ("d", 2, ""),
        ("d", 2, "p"),
    ]
    assert sum(r["image"] is None for r in merged) == 2
    summary = {r["deck"]: (r["total_slides"], r["total_images"], r["status"]) for r in decks.deck_summary(slides, images).collect()}
    assert summary["d"] == (2, 2, "Processed 2 slides. Found 1 images.")
    assert summary["e"][:2] == (1, 0) and summary["f"][:2] == (0, 1)
    failed = spark.createDataFrame([("bad",), ("bad",), ("d",)], "deck string")
    more = {r["deck"]: r["status"] for r in decks.deck_summary(slides, images, failed).collect()}
    assert more["bad"] == "Processed 0 slides. Found 0 images." and more["d"] == summary["d"][2]
    assert sorted(r["image_path"] for r in decks.gallery(images).collect()) == ["p", "q"]


def test_slide_card(spark):
    slides = spark.createDataFrame(
        [("d", 1, "t" * 501, [[["a"]]], "n"), ("d", 2, " ", [], None)],
        "deck string, slide_number int, text_content string, tables array<array<array<string>>>, notes string",
    )
    images = spark.createDataFrame([("d", 1, 0, "p"), ("d", 1, 1, "p")], IMAGES)
    requests = spark.createDataFrame([("d", 0), ("d", 1), ("d", 2), ("d", -1), ("x", 0)], "deck string, slide_idx int")
    cards = {(r["deck"], r["slide_idx"]): r["card"] for r in decks.slide_card(slides, images, requests).collect()}
    assert cards["d", 0] == (
        "**Slide 1**\n\nText: " + "t" * 500 + "...\n\nTables: 1 table(s)\n\nImages: 2 image(s)\n\nNotes: n"
    )
    assert "Text: (no text)" in cards["d", 1] and "Notes: (no notes)" in cards["d", 1]
    assert {cards["d", 2], cards["d", -1], cards["x", 0]} == {fixed.NO_SLIDE_CARD}


def test_only_decks(spark):
    df = spark.createDataFrame([("a.PPTX",), ("a.txt",)], "path string")
    assert decks.only_decks(df).count() == 1


def test_sizes_of_common_formats():
    webp = lambda kind, body: b"RIFF" + bytes(4) + b"WEBP" + kind + bytes(4) + body
    tiff = b"II*\x00\x08\x00\x00\x00\x02\x00" + struct.pack("<HHIHH", 256, 3, 1, 70, 0) + struct.pack("<HHII", 257, 4, 1, 80)
    lossless = webp(b"VP8L", b"\x2f" + struct.pack("<I", (70 - 1) | (80 - 1) << 14))
    lossy = webp(b"VP8 ", bytes(6) + struct.pack("<HH", 70, 80))
    extended = webp(b"VP8X", bytes(4) + (69).to_bytes(3, "little") + (79).to_bytes(3, "little"))
    made = [f(70, 80, "x") for f in (png, gif, jpeg, bmp)]
    assert [picture_size(b) for b in (*made, tiff, lossless, lossy, extended)] == [(70, 80)] * 8
    for blob in (*made, tiff, lossless, lossy, extended):
        for n in range(len(blob)):
            picture_size(blob[:n])
    assert picture_size(None) is None and picture_size(b"") is None


def test_too_large_files_are_errors(spark, tmp_path):
    files = deck_files(spark, write_decks(tmp_path))
    limit = files.agg({"length": "max"}).first()[0] - 1
    rows = parse_decks(files, limit)
    big = [r["deck"] for r in files.filter(f"length > {limit}").select(files.path.alias("deck")).collect()]
    failed = [r["deck"] for r in decks.quarantine(rows).collect() if "bytes" in r["error"]]
    assert sorted(failed) == sorted(big * 2)
    assert rows.filter("slide_number IS NOT NULL").filter(rows.deck.isin(big)).count() == 0


def test_pictures_as_files(spark, tmp_path):
    staged = ingest_decks(spark, write_decks(tmp_path), str(tmp_path / "stage"))
    files = export_images(staged.blobs, str(tmp_path / "pictures")).collect()
    stored = {(r["deck"], r["image_path"]): bytes(r["content"]) for r in staged.blobs.collect()}
    assert {(r["deck"], r["image_path"]): Path(r["file"]).read_bytes() for r in files} == stored


def test_sizes_of_stored_pictures(spark, tmp_path):
    """As they are stored now, by path and by URI; what is gone is left out."""
    rows = [("d1", f"a{n}.png", b"x" * n) for n in range(300)] + [("d2", "a 1%.png", b"yy"), ("d2", "gone.png", b"z")]
    blobs = spark.createDataFrame(rows, "deck string, image_path string, content binary")
    for folder in (str(tmp_path / "plain"), f"file://{tmp_path}/uri"):
        files = export_images(blobs, folder)
        at = {(r["deck"], r["image_path"]): Path(r["file"]) for r in files.collect()}
        at["d2", "gone.png"].unlink()
        at["d1", "a7.png"].write_bytes(b"x" * 9000)
        want = {(d, p): len(c) for d, p, c in rows if p != "gone.png"} | {("d1", "a7.png"): 9000}
        got = [(r["deck"], r["image_path"], r["file_bytes"]) for r in stored_sizes(files, folder).collect()]
        assert sorted(got) == sorted((*k, n) for k, n in want.items())


def test_captioned_pictures_are_not_listed(spark, tmp_path):
    """The driver knows of no picture file: what the query reads are tables only."""
    docs = [(i, f"text {i}", "en" if i % 2 else "fr", "src1", 6) for i in range(60)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = ENTRIES["caption_ingested_pictures"].run(spark, str(tmp_path))
    head = (("png", 24), ("gif", 10), ("jpg", 45), ("bmp", 26))
    want = [(f"deck{i // 12}", i % 12 + 1, 2 + head[i % 3 - 1 + i // 3 % 2 * 2][1]) for i in range(60) if i % 3]
    got = [(r["deck"], r["slide_number"], r["file_bytes"]) for r in found.collect()]
    assert sorted(got) == sorted(want)
    assert all(r["caption"] == f"picture of {r['file_bytes']} bytes" for r in found.collect())
    assert found.inputFiles() and all(f.endswith(".parquet") for f in found.inputFiles())


def many_slides(n=40):
    """Pictures repeat over the whole deck, so copies lie in different shares."""
    return deck_bytes(
        {
            "shapes": [text_box("T", [[f"slide {i}"]]), picture("rA", "a"), picture("rB", "b")],
            "media": [("rA", f"a{i % 7}.png", png(i % 7 + 1, 5)), ("rB", f"b{i}.gif", gif(i + 1, 3))],
            "notes": f"note {i}",
        }
        if i != 11
        else "<broken"
        for i in range(n)
    )


def told_rows(rows):
    return sorted((str(r.asDict(recursive=True)) for r in rows.collect()))


def test_shares_of_a_deck_give_the_rows_of_the_whole(spark, tmp_path):
    (tmp_path / "long.pptx").write_bytes(many_slides())
    (tmp_path / ".hidden.pptx").write_bytes(many_slides(1))
    (tmp_path / "_drafts").mkdir()
    (tmp_path / "_drafts" / "x.pptx").write_bytes(many_slides(1))
    folder = write_decks(tmp_path)
    want = told_rows(parse_decks(deck_files(spark, folder)))
    assert len(want) == 40 + 5 + 2
    for piece in (300, 1_000, 4_000):
        assert told_rows(read_decks(spark, folder, piece)) == want
    assert told_rows(read_decks(spark, folder)) == told_rows(read_decks(spark, f"file://{folder}")) == want
    assert told_rows(read_decks(spark, f"{folder}/[a-l]*")) == want


def test_a_share_reads_only_its_slides(tmp_path):
    """Bytes read from the file for one share of many."""
    (tmp_path / "deck.pptx").write_bytes(deck_bytes({"shapes": [picture("r")], "media": [("r", f"m{i}.bin", random.Random(i).randbytes(50_000))]} for i in range(50)))

    class Counting(io.FileIO):
        taken = 0

        def read(self, n=-1):
            data = super().read(n)
            self.taken += len(data)
            return data

    size = (tmp_path / "deck.pptx").stat().st_size
    with Counting(tmp_path / "deck.pptx") as file:
        assert [r["slide_number"] for r in slides_of("d", file, 3, 10)] == [16, 17, 18, 19, 20]
        assert file.taken < size / 5


def test_a_deck_beyond_what_a_column_holds_is_read(spark, tmp_path):
    """A file of 2.2 GB (a hole ahead of the archive, so it takes no disk) in shares."""
    for folder in ("large", "small"):
        (tmp_path / folder).mkdir()
    with open(tmp_path / "large" / "huge.pptx", "wb") as out:
        out.truncate(2_200_000_000)
        out.seek(0, 2)
        out.write(many_slides())
    large = str(tmp_path / "large")
    assert quarantine(parse_decks(deck_files(spark, large))).count() == 2
    rows = read_decks(spark, large)
    (tmp_path / "small" / "huge.pptx").write_bytes(many_slides())
    want = parse_decks(deck_files(spark, str(tmp_path / "small")))
    assert told_rows(by_deck(rows)) == told_rows(by_deck(want))


def test_files_are_dealt_by_size():
    files = [Share(f"{i}", size) for i, size in enumerate((10, 10, 250, 0, 90, 10))]
    got = dealt(files, 100, 2)
    assert [[(s.file, s.nth, s.of) for s in part] for part in got] == [
        [("2", 0, 3)], [("2", 1, 3)], [("2", 2, 3)], [("0", 0, 1), ("1", 0, 1), ("3", 0, 1), ("4", 0, 1)], [("5", 0, 1)],
    ]
    assert dealt([], 100, 4) == [] and len(dealt([Share("a", 0)], 100, 4)) == 1


def test_options_of_the_source_hold(spark, tmp_path):
    """Shares are as large as asked for, and files above the usual size are not lost."""
    (tmp_path / "long.pptx").write_bytes(many_slides())
    size = (tmp_path / "long.pptx").stat().st_size
    spark.dataSource.register(DeckSource)

    def read(piece, which="all"):
        reader = spark.read.format("decks").option("pieceBytes", piece).option("leastPartitions", 4)
        return reader.option("which", which).load(str(tmp_path))

    assert read(size // 8).rdd.getNumPartitions() == 9
    assert read(size // 8, "cut").count() == read(size, "whole").count() == 40
    assert read(size // 8, "whole").count() == read(size, "cut").count() == 0


def test_small_shares_are_joined():
    parts = dealt([Share("a", 100_000), Share("b", 50)], 100, 2)
    assert len(parts) == 1_001
    got = joined(parts, 2)
    assert [s for part in got for s in part] == [s for part in parts for s in part] and len(got) == 9
    assert all(sum(s.size / s.of for s in part) <= 100_050 / 8 for part in got)
    large = dealt([Share("a", 20 * PIECE_BYTES)], PIECE_BYTES, 4)
    assert joined(large, 1) == large and joined([], 4) == []
    many = joined(dealt([Share("a", 20 * PIECE_BYTES)], 10_000, 4), 1)
    assert 20 <= len(many) <= 21


def test_whole_files_reach_python_in_short_batches(spark, tmp_path):
    """Sizes of the batches that a job inside is handed, beside those of one outside."""
    files = spark.range(0, 40, 1, 1).select(F.expr("cast(repeat('x', 1000000) as binary)").alias("content"))

    def taken(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["n"])

    def largest():
        return files.mapInArrow(taken, "n long").agg(F.max("n")).first()[0]

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with file_batches(spark):
        inside = largest()
        with file_batches(spark, 1):
            assert largest() < 2_000_000
    assert inside < 11_000_000 < largest() and spark.conf.get(name) == before
    spark.conf.set(name, "1m")
    try:
        with file_batches(spark):
            assert largest() < 3_000_000
    finally:
        spark.conf.set(name, before)
    out = export_images(files.select(F.lit("d").alias("deck"), F.expr("uuid()").alias("image_path"), "content"), str(tmp_path / "f"))
    assert out.count() == 40 and spark.conf.get(name) == before
