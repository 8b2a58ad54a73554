"""Alignment of two tokenizers' tokens by pointer jumping.

Both tokenizers cut the same bytes. Every token points to the farthest-right token of the
other kind that overlaps it, or to itself where both end together and nothing lies farther right.
Replacing each pointer by its pointer's pointer doubles the reach until nothing moves: then
every token points to the last one of its group, the least stretch of bytes that both cut at its ends.
Documents lie behind each other in one array, since a document's end is an end of both.

A link is a pair of tokens that end together. The shorter one is then a suffix of the longer
one, so there are no more different pairs than suffixes of entries that are entries: the
counts of pairs have a size that the two vocabularies bound, however large the corpus is.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm.packing import BLANKS, LONG_BLANK, encoding
from lectern.llm.token_counts import byte_letters
from lectern.session import materialise

#: Texts are encoded and aligned together up to about so many characters.
CHARS = 500_000


class ByteTokens:
    """A byte-level vocabulary: ids of ``" " + text``, in which strings of special tokens are
    plain text, and the bytes of each id."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = byte_letters()
        entries = {i: t for t, i in model["model"]["vocab"].items()}
        self.bytes = [b""] * (max([*entries, *[t["id"] for t in model["added_tokens"]]]) + 1)
        for i, token in entries.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def ids(self, text: str) -> list[int]:
        text = " " + text
        if len(text) < LONG_BLANK or not BLANKS.search(text):
            try:
                return encoding(self.path).encode_ordinary(text)
            except ValueError:  # beyond the limits of its patterns
                pass
        return plain_library(self.path).encode(text, add_special_tokens=False).ids


class PieceTokens:
    """A piece vocabulary, whose library puts the blank ahead of the text itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@functools.cache
def plain_library(path: str) -> Tokenizer:
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return library


@functools.cache
def tokens(a_path: str, b_path: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(a_path), PieceTokens(b_path)


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of an entry of each kind can end together."""

    def suffixes(longer: list[bytes], others: list[bytes], least: int) -> int:
        n: dict[bytes, int] = {}
        for entry in others:
            n[entry] = n.get(entry, 0) + 1
        return sum(n.get(entry[at:], 0) for entry in longer for at in range(least, len(entry)))

    return suffixes(a, b, 0) + suffixes(b, a, 1)


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """The place, among the tokens of A and then those of B, of the last token of each token's
    group: always one of B. Ends are byte offsets, rising; the last ends of A and B are equal."""
    n = len(a_ends)
    # The token of the other kind that covers a token's last byte ends farthest right.
    over_a = np.searchsorted(b_ends, a_ends)
    over_b = np.searchsorted(a_ends, b_ends)
    farther = a_ends[over_b] > b_ends if n else np.zeros(0, bool)
    to = np.concatenate((n + over_a, np.where(farther, over_b, n + np.arange(len(b_ends)))))
    while True:
        jumped = to[to]
        if np.array_equal(jumped, to):
            return to
        to = jumped


@dataclass(frozen=True)
class Aligned:
    """Groups of several documents: per group the places of its last tokens, which are linked."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray

    @classmethod
    def of(cls, a_ids: np.ndarray, b_ids: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> Aligned:
        a_ends, b_ends = np.cumsum(a_sizes[a_ids]), np.cumsum(b_sizes[b_ids])
        last = terminals(a_ends, b_ends)
        b_last = np.unique(last) - len(a_ids)
        a_last = np.searchsorted(a_ends, b_ends[b_last])
        return cls(a_ids, b_ids, a_last, b_last)

    def texts(self, names: Names) -> np.ndarray:
        """Of each token its id and what separates it from the next one, in the order of
        ``a1,a2|b1;a3|b2,b3``."""
        a_group = np.searchsorted(self.a_last, np.arange(len(self.a_ids)))
        b_group = np.searchsorted(self.b_last, np.arange(len(self.b_ids)))
        # Ahead of a token of A lie the B tokens of earlier groups, ahead of one of B the A
        # tokens of its own as well.
        a_place = np.arange(len(self.a_ids)) + np.r_[0, self.b_last + 1][a_group]
        b_place = np.arange(len(self.b_ids)) + (self.a_last + 1)[b_group]
        out = np.empty(len(self.a_ids) + len(self.b_ids), object)
        out[a_place], out[b_place] = names.comma[self.a_ids], names.comma[self.b_ids]
        out[a_place[self.a_last]] = names.bar[self.a_ids[self.a_last]]
        out[b_place[self.b_last]] = names.semicolon[self.b_ids[self.b_last]]
        return out


class Names:
    """Ids in decimal, with each separator."""

    def __init__(self, n: int):
        for name, sign in (("comma", ","), ("bar", "|"), ("semicolon", ";")):
            values = np.empty(n, object)
            values[:] = [f"{i}{sign}" for i in range(n)]
            setattr(self, name, values)


@functools.cache
def names(n: int) -> Names:
    return Names(n)


ALIGNED = "n_a long, n_b long, n_groups long, groups string, link_a array<int>, link_b array<int>"


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups, link_a, link_b``: the tokens of each whole text by
    both vocabularies (a ``.json`` of byte-level entries, a ``.model`` of pieces), cut into
    groups where both end.

    ``groups`` lists the ids as ``a1,a2|b1;a3|b2,b3``; ``link_a`` and ``link_b`` hold the ids
    of tokens that end together, in order. Texts that are null or empty, or whose pieces'
    bytes are not those of the text behind a blank, have no tokens: zeros, "" and empty lists.
    Every row is kept, whatever its id; extra columns are ignored; an empty table gives no
    rows.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokens(a_path, b_path)
        sizes = [np.array([len(x) for x in kind.bytes], np.int64) for kind in (a, b)]
        written = names(max(map(len, sizes)))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            upto = np.cumsum([len(t or "") for t in texts]) // CHARS
            starts = np.flatnonzero(np.diff(upto, prepend=-1))
            for start, stop in zip(starts, np.r_[starts[1:], len(texts)]):
                part = texts[start:stop]
                both = []
                for text in part:
                    pair = ([], [])
                    if text:
                        found, whole = (a.ids(text), b.ids(text)), (" " + text).encode()
                        if all(b"".join(map(k.bytes.__getitem__, ids)) == whole for k, ids in zip((a, b), found)):
                            pair = found
                    both.append(pair)
                n_a, n_b = (np.array([len(pair[k]) for pair in both], np.int64) for k in (0, 1))
                a_ids, b_ids = (np.array([i for pair in both for i in pair[k]], np.int32) for k in (0, 1))
                groups = Aligned.of(a_ids, b_ids, *sizes)
                text = groups.texts(written)
                token_to = np.cumsum(n_a + n_b)
                group_to = np.searchsorted(groups.b_last, np.cumsum(n_b))
                offsets = pa.array(np.r_[0, group_to], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start),
                        pa.array(n_a, pa.int64()),
                        pa.array(n_b, pa.int64()),
                        pa.array(np.diff(np.r_[0, group_to]), pa.int64()),
                        pa.array(["".join(text[s:e])[:-1] for s, e in zip(np.r_[0, token_to[:-1]], token_to)], pa.string()),
                        pa.ListArray.from_arrays(offsets, pa.array(a_ids[groups.a_last], pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(b_ids[groups.b_last], pa.int32())),
                    ],
                    ["doc_id", *[c.split()[0] for c in ALIGNED.split(", ")]],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(align, f"doc_id {kind}, {ALIGNED}")


def codes_of(link_a: np.ndarray, link_b: np.ndarray) -> np.ndarray:
    return link_b.astype(np.int64) << 32 | link_a


def lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The links of a batch as codes, and where each row's begin and end."""
    a, b = batch.column(batch.schema.get_field_index("link_a")), batch.column(batch.schema.get_field_index("link_b"))
    offsets = a.offsets.to_numpy()
    return codes_of(a.flatten().to_numpy(), b.flatten().to_numpy()), offsets - offsets[0]


def count_links(aligned: DataFrame) -> DataFrame:
    """``pair, n``: how many links of all rows hold each pair of ids. Tasks count their own
    rows first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            found, counts = np.unique(lists(batch)[0], return_counts=True)
            held, where = np.unique(np.r_[held, found], return_inverse=True)
            n = np.bincount(where, np.r_[n, counts], len(held)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n)], ["pair", "n"])

    counted = aligned.select("link_a", "link_b").mapInArrow(count, "pair long, n long")
    return counted.groupBy("pair").agg(F.sum("n").alias("n"))


def with_link_counts(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of ``align_tokens``, without the lists of links but with ``n_links``, ``n_best``
    (links whose pair is the commonest of its B id over all rows, ties included) and
    ``count_sum`` (the pairs' counts added up over the row's links).

    The rows are written once, since they are read twice. The counts of pairs are sent
    to the tasks: there are at most ``most_pairs`` of them, which the vocabularies fix.
    """
    spark = aligned.sparkSession
    aligned = materialise(aligned, "aligned")
    counted = count_links(aligned).toArrow().sort_by("pair")
    pairs, n = (counted.column(c).to_numpy() for c in ("pair", "n"))
    a, b = tokens(a_path, b_path)
    if len(pairs) > (bound := most_pairs(a.bytes, b.bytes)):
        raise ValueError(f"{len(pairs)} pairs, of which the vocabularies allow {bound}")
    b_of = pairs >> 32
    first = np.flatnonzero(np.r_[True, b_of[1:] != b_of[:-1]]) if len(pairs) else np.zeros(0, np.int64)
    highest = np.repeat(np.maximum.reduceat(n, first), np.diff(np.r_[first, len(n)])) if len(pairs) else n
    sent = spark.sparkContext.broadcast((pairs, n, n == highest))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for batch in batches:
            codes, offsets = lists(batch)
            at = np.searchsorted(pairs, codes)
            sums = [np.diff(np.r_[0, np.cumsum(v[at])][offsets]) for v in (n, best.astype(np.int64))]
            kept = [c for c in batch.schema.names if c not in ("link_a", "link_b")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in kept],
                 *[pa.array(v, pa.int64()) for v in (np.diff(offsets), sums[1], sums[0])]],
                [*kept, "n_links", "n_best", "count_sum"],
            )

    fields = [f"`{c}` {t}" for c, t in aligned.dtypes if c not in ("link_a", "link_b")]
    return aligned.mapInArrow(add, ", ".join([*fields, "n_links long, n_best long, count_sum long"]))
