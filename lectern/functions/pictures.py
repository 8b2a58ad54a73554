"""Width and height of a picture from its bytes, by the headers of the common formats."""

from __future__ import annotations

import struct

# File signatures of the formats, markers of JPEG frames, tags of TIFF.
PNG, BMP, RIFF, JPEG = b"\x89PNG\r\n\x1a\n", b"BM", b"RIFF", b"\xff\xd8"
GIFS = (b"GIF87a", b"GIF89a")
TIFFS = {b"II*\x00": "<", b"MM\x00*": ">"}
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
BARE = frozenset(range(0xD0, 0xD8)) | {0x01}
TIFF_SIZE = {256: 0, 257: 1}

Size = tuple[int, int]


def _jpeg(blob: bytes) -> Size | None:
    """The size in the first frame header; segments ahead of it are skipped by length."""
    at = 2
    while at + 4 <= len(blob):
        if blob[at] != 0xFF:
            return None
        marker = blob[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker in BARE:
            at += 2
        elif marker in FRAMES:
            height, width = struct.unpack_from(">HH", blob, at + 5)
            return width, height
        else:
            at += 2 + struct.unpack_from(">H", blob, at + 2)[0]
    return None


def _tiff(blob: bytes, order: str) -> Size | None:
    (at,) = struct.unpack_from(f"{order}I", blob, 4)
    (entries,) = struct.unpack_from(f"{order}H", blob, at)
    found: list[int | None] = [None, None]
    for i in range(entries):
        tag, kind = struct.unpack_from(f"{order}HH", blob, at + 2 + 12 * i)
        if tag in TIFF_SIZE:
            (found[TIFF_SIZE[tag]],) = struct.unpack_from(order + ("H" if kind == 3 else "I"), blob, at + 10 + 12 * i)
    return None if None in found else (found[0], found[1])


def _webp(blob: bytes) -> Size | None:
    kind = blob[12:16]
    if kind == b"VP8X":
        width, height = (int.from_bytes(blob[i : i + 3], "little") + 1 for i in (24, 27))
        return (width, height) if len(blob) >= 30 else None
    if kind == b"VP8L":
        (bits,) = struct.unpack_from("<I", blob, 21)
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 ":
        width, height = struct.unpack_from("<HH", blob, 26)
        return width & 0x3FFF, height & 0x3FFF
    return None


def picture_size(blob: bytes | None) -> Size | None:
    """Width and height; null for other formats and for headers that are cut off."""
    if not blob:
        return None
    try:
        if blob.startswith(PNG):
            return struct.unpack_from(">II", blob, 16)
        if blob.startswith(GIFS):
            return struct.unpack_from("<HH", blob, 6)
        if blob.startswith(BMP):
            if struct.unpack_from("<I", blob, 14)[0] == 12:
                return struct.unpack_from("<HH", blob, 18)
            width, height = struct.unpack_from("<ii", blob, 18)
            return width, abs(height)
        if blob.startswith(JPEG):
            return _jpeg(blob)
        if blob[:4] in TIFFS:
            return _tiff(blob, TIFFS[blob[:4]])
        if blob.startswith(RIFF) and blob[8:12] == b"WEBP":
            return _webp(blob)
    except struct.error:
        return None
    return None
