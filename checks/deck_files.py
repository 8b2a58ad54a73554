"""Deck files made by Spark from the documents, to feed the deck reader."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterable
from typing import Any
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from checks import inputs

SPACES = (
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" '
    'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
)
KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _paragraph(runs: list[str]) -> str:
    return "<a:p>" + "".join(f"<a:r><a:t>{escape(r)}</a:t></a:r>" for r in runs) + "</a:p>"


def text_box(name: str, paragraphs: list[list[str]], holder: str = "") -> str:
    body = "".join(map(_paragraph, paragraphs))
    return (
        f'<p:sp><p:nvSpPr><p:cNvPr id="2" name={quoteattr(name)}/><p:cNvSpPr txBox="1"/>'
        f"<p:nvPr>{holder}</p:nvPr></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>"
    )


def table_frame(rows: list[list[str]]) -> str:
    cells = "".join(
        "<a:tr>" + "".join(f"<a:tc><a:txBody>{_paragraph([c])}</a:txBody></a:tc>" for c in row) + "</a:tr>"
        for row in rows
    )
    return f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl>{cells}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>"


def picture(relation: str, name: str = "picture") -> str:
    return (
        f'<p:pic><p:nvPicPr><p:cNvPr id="9" name={quoteattr(name)}/><p:cNvPicPr/><p:nvPr/></p:nvPicPr>'
        f'<p:blipFill><a:blip r:embed="{relation}"/></p:blipFill></p:pic>'
    )


def group(*shapes: str) -> str:
    return f"<p:grpSp><p:nvGrpSpPr/><p:grpSpPr/>{''.join(shapes)}</p:grpSp>"


def png(width: int, height: int, salt: str = "") -> bytes:
    return b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", width, height) + salt.encode()


def gif(width: int, height: int, salt: str = "") -> bytes:
    return b"GIF89a" + struct.pack("<HH", width % 65536, height) + salt.encode()


def jpeg(width: int, height: int, salt: str = "") -> bytes:
    note = salt.encode()
    comment = b"\xff\xfe" + struct.pack(">H", len(note) + 2) + note
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, height, width % 65536, 3) + bytes(9)
    return b"\xff\xd8\xff\xe0\x00\x10JFIF" + bytes(10) + comment + frame + b"\xff\xd9"


def bmp(width: int, height: int, salt: str = "") -> bytes:
    return b"BM" + bytes(12) + struct.pack("<Iii", 40, width, -height) + salt.encode()


def _relations(entries: list[tuple[str, str, str]]) -> str:
    rows = "".join(f'<Relationship Id="{i}" Type="{KIND}/{k}" Target="{t}"/>' for i, k, t in entries)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>'


def deck_bytes(slides: Iterable[dict[str, Any]]) -> bytes:
    """A deck from slides with ``shapes`` (XML), ``notes`` and ``media`` (relation, file name,
    bytes); a slide given as text is stored as it is."""
    out = io.BytesIO()
    listed, relations = [], []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for n, slide in enumerate(slides, start=1):
            listed.append(f'<p:sldId id="{255 + n}" r:id="rId{n}"/>')
            relations.append((f"rId{n}", "slide", f"slides/slide{n}.xml"))
            if isinstance(slide, str):
                archive.writestr(f"ppt/slides/slide{n}.xml", slide)
                continue
            tree = "".join(slide.get("shapes", []))
            archive.writestr(
                f"ppt/slides/slide{n}.xml",
                f"<p:sld {SPACES}><p:cSld><p:spTree><p:nvGrpSpPr/><p:grpSpPr/>{tree}</p:spTree></p:cSld></p:sld>",
            )
            own = [(i, "image", f"../media/{file}") for i, file, _ in slide.get("media", [])]
            if slide.get("notes") is not None:
                own.append(("rIdNotes", "notesSlide", f"../notesSlides/notesSlide{n}.xml"))
                body = text_box("Notes", [[slide["notes"]]], '<p:ph type="body" idx="1"/>')
                archive.writestr(
                    f"ppt/notesSlides/notesSlide{n}.xml",
                    f"<p:notes {SPACES}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:notes>",
                )
            archive.writestr(f"ppt/slides/_rels/slide{n}.xml.rels", _relations(own))
            for _, file, blob in slide.get("media", []):
                if f"ppt/media/{file}" not in archive.namelist():
                    archive.writestr(f"ppt/media/{file}", blob)
        archive.writestr(
            "ppt/presentation.xml",
            f"<p:presentation {SPACES}><p:sldIdLst>{''.join(listed)}</p:sldIdLst></p:presentation>",
        )
        archive.writestr("ppt/_rels/presentation.xml.rels", _relations(relations))
    return out.getvalue()


def _words(line: str) -> list[str]:
    first, *rest = line.split(" ")
    return [first, *(" " + w for w in rest)]


def _document_slide(doc: Any) -> dict[str, Any]:
    """A document as a slide, shaped as in ``inputs.deck_rows``, with a picture in two of three."""
    boxes = [text_box(f"line {i}", [_words(t)]) for i, t in enumerate(doc.text.split("\n"))]
    if doc.doc_id % 2 == 0:
        boxes.append(table_frame([[doc.source, ""], [doc.lang, str(doc.n_chars)]]))
    media = []
    if doc.doc_id % 3:
        makers = (("png", png), ("gif", gif), ("jpg", jpeg), ("bmp", bmp))
        kind, make = makers[doc.doc_id % 3 - 1 + doc.doc_id // 3 % 2 * 2]
        blob = make(len(doc.text.encode()), doc.doc_id % 500 + 1, doc.lang)
        media = [("rIdPicture", f"image{doc.doc_id}.{kind}", blob)]
        boxes.append(group(picture("rIdPicture")))
    return {"shapes": boxes, "media": media, "notes": "" if doc.lang == "en" else doc.lang}


def _pack(docs: pd.DataFrame) -> pd.DataFrame:
    rows = docs.sort_values("doc_id").itertuples(index=False)
    content = deck_bytes(_document_slide(doc) for doc in rows)
    return pd.DataFrame({"path": [docs["deck"].iloc[0]], "content": [content]})


def deck_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` of one file per twelve documents."""
    docs = inputs.table(spark, folder, "documents").withColumn("deck", inputs.deck_name())
    return docs.groupBy("deck").applyInPandas(_pack, "path string, content binary")
