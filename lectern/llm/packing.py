"""Hierarchical packing of documents into windows of several lengths.

A document's tokens beyond whole windows form its tail. Tails are routed to the shortest
tier that holds them. Tiers are packed from the longest: each tail of a tier opens a window,
the gap is filled with whole tails of shorter tiers, best fit first, and what is then left
with a cut from a shorter one. So every window is filled exactly; only what remains at the
end of a partition is cut to powers of two. Windows of a tier are dealt into step groups of
equal token counts and nearly equal attention work.

All of it happens where a partition is read: nothing is shuffled, and a task holds one pool
of tails of bounded size.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm.token_counts import SPLIT, byte_letters

TIERS = (256, 512, 1024, 2048)
#: Tokens of tails a task holds before it packs them.
POOL_TOKENS = 2_000_000
#: Tokens of one training step.
STEP_TOKENS = 65_536
#: Texts are handed on in batches of about this many tokens.
OUT_TOKENS = 2_000_000
#: Texts with so many white-space characters in a row are left to the tokenizer's own library:
#: the faster one keeps a place to go back to for each, of which it allows a million.
LONG_BLANK = 100_000
BLANKS = re.compile(rf"(?<!\s)\s{{{LONG_BLANK}}}")


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a tokenizer file. Its ids are in merge order, so they are
    also the ranks by which this library, several times as fast, finds the same ids."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"]: t["id"] for t in model["added_tokens"] if t["special"]}
    letters = byte_letters()
    ranks = {
        bytes(letters[c] for c in token): i
        for token, i in model["model"]["vocab"].items()
        if token not in special
    }
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


@functools.cache
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def token_ids(path: str, text: str) -> list[int]:
    """The ids of any text; strings of special tokens count as that token."""
    if len(text) < LONG_BLANK or not BLANKS.search(text):
        try:
            return encoding(path).encode(text, allowed_special="all")
        except ValueError:  # beyond the limits of its patterns
            pass
    return library(path).encode(text, add_special_tokens=False).ids


@dataclass(slots=True)
class Piece:
    """``length`` ids of a document from ``start``."""

    row: int
    start: int
    length: int

    def cut(self, n: int) -> Piece:
        """The first ``n`` ids; this piece keeps the rest."""
        head = Piece(self.row, self.start, n)
        self.start += n
        self.length -= n
        return head


class Tails:
    """Tails sorted by length."""

    def __init__(self, pieces: list[Piece]):
        self.pieces = sorted(pieces, key=lambda p: (p.length, p.row, p.start))
        self.lengths = [p.length for p in self.pieces]

    def __len__(self) -> int:
        return len(self.pieces)

    def pop(self, at: int) -> Piece:
        del self.lengths[at]
        return self.pieces.pop(at)

    def add(self, piece: Piece) -> None:
        at = bisect.bisect_left(self.lengths, piece.length)
        self.lengths.insert(at, piece.length)
        self.pieces.insert(at, piece)

    def filler(self, gap: int) -> Piece:
        """The longest tail that fits, or a cut of the shortest that doesn't."""
        if at := bisect.bisect_right(self.lengths, gap):
            return self.pop(at - 1)
        whole = self.pop(0)
        head = whole.cut(gap)
        self.add(whole)
        return head


def pack_tails(pieces: list[Piece], tiers: tuple[int, ...]) -> tuple[list[list[Piece]], list[Piece]]:
    """Windows filled to the length of a tier, and the pieces of the one that isn't full."""
    tails, windows = Tails(pieces), []
    for k in range(len(tiers) - 1, -1, -1):
        size, shorter = tiers[k], tiers[k - 1] if k else 0
        while len(tails) and tails.lengths[-1] > shorter:
            window = [tails.pop(len(tails) - 1)]
            gap = size - window[0].length
            while gap and len(tails):
                window.append(tails.filler(gap))
                gap -= window[-1].length
            if gap:
                return windows, window
            windows.append(window)
    return windows, []


def power_cuts(pieces: list[Piece]) -> list[list[Piece]]:
    """Pieces cut into sequences whose lengths are powers of two, the longest first."""
    left, windows = [p for p in pieces], []
    total = sum(p.length for p in pieces)
    while total:
        gap = size = 1 << (total.bit_length() - 1)
        window = []
        while gap:
            piece = left[0]
            if piece.length <= gap:
                window.append(left.pop(0))
            else:
                window.append(piece.cut(gap))
            gap -= window[-1].length
        windows.append(window)
        total -= size
    return windows


def step_groups(windows: list[list[Piece]], step_tokens: int) -> list[int]:
    """A group per window: windows of one length, so many that a group has ``step_tokens``,
    dealt to and fro by attention work."""
    groups, used = [0] * len(windows), 0
    sizes = [sum(p.length for p in w) for w in windows]
    for size in sorted(set(sizes)):
        mine = [i for i, s in enumerate(sizes) if s == size]
        mine.sort(key=lambda i: -sum(p.length**2 for p in windows[i]))
        n = -(-len(mine) * size // step_tokens)
        for place, i in enumerate(mine):
            turn, at = divmod(place, n)
            groups[i] = used + (n - 1 - at if turn % 2 else at)
        used += n
    return groups


class Packer:
    """Packs the documents of one partition as they come."""

    def __init__(self, partition: int, tiers: tuple[int, ...], step_tokens: int, pool_tokens: int):
        self.tiers, self.step_tokens, self.pool_tokens = tiers, step_tokens, pool_tokens
        self.base = partition << 40
        self.sequences = self.groups = 0
        self.docs: list[tuple[object, np.ndarray]] = []
        self.whole: list[list[Piece]] = []
        self.tails: list[Piece] = []
        self.held = 0

    def add(self, key: object, ids: np.ndarray) -> bool:
        """Take a document; true once the pool is to be packed."""
        row, window, n = len(self.docs), self.tiers[-1], len(ids)
        self.docs.append((key, ids))
        self.whole += [[Piece(row, s, window)] for s in range(0, n - n % window, window)]
        if n % window:
            self.tails.append(Piece(row, n - n % window, n % window))
        self.held += n
        return self.held >= self.pool_tokens

    def flush(self, last: bool) -> Iterator[tuple]:
        """Rows of all windows that are full; at the end, of all."""
        windows, rest = pack_tails(self.tails, self.tiers)
        if last:
            windows += power_cuts(rest)
            rest = []
        windows = self.whole + windows
        groups = step_groups(windows, self.step_tokens)
        for window, group in zip(windows, groups):
            offset, size = 0, sum(p.length for p in window)
            for p in window:
                key, ids = self.docs[p.row]
                cut = ids[p.start : p.start + p.length].astype("<u4").tobytes()
                yield (
                    key, p.start, p.length, cut, len(ids),
                    self.base + self.sequences, offset, size, self.base + self.groups + group,
                )
                offset += p.length
            self.sequences += 1
        self.groups += max(groups, default=-1) + 1
        kept = sorted({p.row for p in rest})
        place = {row: i for i, row in enumerate(kept)}
        self.docs = [self.docs[row] for row in kept]
        self.tails = [Piece(place[p.row], p.start, p.length) for p in rest]
        self.whole, self.held = [], sum(p.length for p in rest)


def pack(
    docs: DataFrame,
    path: str,
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    pool_tokens: int = POOL_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Token sequences of documents, one row per piece of a document.

    ``id_col, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens`` (with the
    end id), ``sequence_id, offset, sequence_length, step_group``. ``path`` is a byte-level
    vocabulary every worker has. ``tiers`` are window lengths, powers of two, ascending. All
    sequences have the length of a tier, but those at the end of a partition, which have
    smaller powers of two; none needs padding.

    A null text is empty and gives the end id alone. Repeated rows and rows with a null id
    are packed each. Other columns of ``docs`` are left out. No rows give no sequences.
    """
    if any(t & (t - 1) or t < 1 for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers are ascending powers of two")
    key_type = docs.schema[id_col].dataType
    fields = (
        "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
        "sequence_length long, step_group long"
    )
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens, pool_tokens)
        key_arrow: pa.DataType | None = None

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            rows, tokens = [], 0
            for row in packer.flush(last):
                rows.append(row)
                tokens += row[2]
                if tokens >= OUT_TOKENS:
                    yield made(rows)
                    rows, tokens = [], 0
            if rows:
                yield made(rows)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays = [pa.array(columns[0], key_arrow)]
            arrays += [pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns[1:])]
            return pa.RecordBatch.from_arrays(arrays, ["key", *names])

        for batch in batches:
            key_arrow = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            for key, text in zip(keys, batch.column(1)):
                ids = token_ids(path, text.as_py() or "")
                if packer.add(key, np.array([*ids, end_id], np.uint32)):
                    yield from out(False)
        if key_arrow is not None:
            yield from out(True)

    narrow = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    pieces = narrow.mapInArrow(run, f"key {key_type.simpleString()}, {fields}")
    return pieces.select(F.col("key").alias(id_col), *names)
