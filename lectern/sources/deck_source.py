"""The data source ``decks``: files of any size as rows of slides.

A partition is some small files or a share of a large one's slides; shares of few bytes are
read one after the other in one partition. Archives are read by range, from where they are: the listing at their end, then the entries of one slide after the
other. So a task holds a slide, whatever the size of its deck, and the slides of a large deck
are spread over tasks.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lectern.schemas import DECK_ROW

#: Larger files are cut into shares of about this size, smaller ones read together up to it.
PIECE_BYTES = 64 << 20
#: Smaller partitions are joined up to ``PIECE_BYTES`` while there are so many times the least.
ROUNDS = 4
#: Rows go to Spark in batches of this size.
BATCH_SLIDES = 200
BATCH_BYTES = 16 << 20
# Schemes by the names that the file system library knows.
SCHEMES = {"": "file", "file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


@dataclass(frozen=True)
class Share:
    """The ``nth`` of ``of`` shares of a file's slides."""

    file: str
    size: int
    nth: int = 0
    of: int = 1


class Shares(InputPartition):
    def __init__(self, shares: list[Share]):
        super().__init__(None)
        self.shares = shares


def reachable(path: str) -> bool:
    """Can the path be listed and read by range from Python? Patterns and the schemes that
    only Spark resolves can't."""
    return bool(SCHEMES.get(urlsplit(path).scheme, "")) and not any(c in path for c in "*?[{")


def store_of(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, the path in it, and what leads from there to a file's name in
    Spark."""
    parts = urlsplit(path)
    if SCHEMES[parts.scheme] == "file":
        return fs.LocalFileSystem(), posixpath.abspath(parts.path) if parts.path else ".", "file:"
    store, root = fs.FileSystem.from_uri(path.replace(parts.scheme, SCHEMES[parts.scheme], 1))
    prefix = f"{parts.scheme}://{parts.netloc}" if root.startswith("/") else f"{parts.scheme}://"
    return store, root, prefix


def listed(path: str) -> list[Share]:
    """The .pptx files (in any case) at or below a path, by name; hidden ones aside."""
    store, root, _ = store_of(path)
    info = store.get_file_info(root)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))

    def shown(name: str) -> bool:
        return not any(part[:1] in ("_", ".") for part in name[len(root) :].split("/"))

    decks = (f for f in found if f.is_file and f.path.lower().endswith(".pptx") and shown(f.path))
    return [Share(f.path, f.size) for f in sorted(decks, key=lambda f: f.path)]


def dealt(files: list[Share], piece: int, least: int) -> list[list[Share]]:
    """Files as the shares of partitions: large ones cut, others read together, in ``least``
    partitions or more if there are as many files."""
    together = max(1, min(piece, sum(f.size for f in files) // max(least, 1)))
    out: list[list[Share]] = []
    held, size = [], 0
    for f in files:
        of = -(-f.size // piece)
        if of > 1:
            out.extend([Share(f.file, f.size, n, of)] for n in range(of))
            continue
        held.append(f)
        size += f.size
        if size >= together:
            out.append(held)
            held, size = [], 0
    return [*out, held] if held else out


def joined(parts: list[list[Share]], least: int) -> list[list[Share]]:
    """Partitions of few bytes taken together in their order, so that their number follows the
    bytes, not the size of shares: up to ``PIECE_BYTES``, and less for ``ROUNDS * least``."""
    sizes = [sum(s.size / s.of for s in part) for part in parts]
    most = min(PIECE_BYTES, sum(sizes) / (ROUNDS * max(least, 1)))
    out: list[list[Share]] = []
    held = 0.0
    for part, size in zip(parts, sizes):
        if out and held + size <= most:
            out[-1].extend(part)
            held += size
        else:
            out.append(list(part))
            held = size
    return out


def batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Deck rows in batches of bounded size."""
    schema = to_arrow_schema(DECK_ROW)
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(b) for b in row.get("blobs", []) if b)
        if size > BATCH_BYTES or len(held) == BATCH_SLIDES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


class DeckReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.path = options["path"]
        self.piece = int(options.get("pieceBytes", PIECE_BYTES))
        self.least = int(options.get("leastPartitions", 1))
        self.which = options.get("which", "all")

    def partitions(self) -> list[Shares]:
        wanted = {"all": lambda f: True, "whole": lambda f: f.size <= self.piece, "cut": lambda f: f.size > self.piece}
        files = [f for f in listed(self.path) if wanted[self.which](f)]
        parts = joined(dealt(files, self.piece, self.least), self.least)
        return [Shares(shares) for shares in parts] or [Shares([])]

    def read(self, partition: Shares) -> Iterator[pa.RecordBatch]:
        from lectern.sources.decks import slides_of

        store, _, prefix = store_of(self.path)

        def rows() -> Iterator[dict]:
            for share in partition.shares:
                with store.open_input_file(share.file) as file:
                    yield from slides_of(prefix + share.file, file, share.nth, share.of)

        yield from batches(rows())


class DeckSource(DataSource):
    """``spark.read.format("decks")`` with ``path``, and ``pieceBytes`` (the size of shares),
    ``leastPartitions`` and ``which`` ("whole" files or "cut" ones, else all).

    Pictures of a cut file are compared within a share; ``decks.read_decks`` compares them
    within the file.
    """

    @classmethod
    def name(cls) -> str:
        return "decks"

    def schema(self) -> StructType:
        return DECK_ROW

    def reader(self, schema: StructType) -> DeckReader:
        # Not as a plain dict, whose names would be in lower case.
        return DeckReader(self.options)
