"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens are held as one flat array of symbols with the start of each sequence. In every
round each sequence applies its own lowest-ranked pair at all places at once, and sequences
without a known pair leave. A merge makes a symbol that no lower-ranked pair contains, so
this ends with the symbols of the one-pair-at-a-time rule; counting needs no more than that.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: The split of the byte-level vocabularies, and its special string.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Below this, and in general punctuation, both libraries class characters alike. Texts with
#: others are split by the tokenizer's own library, as Unicode versions differ.
UNSURE = regex.compile(r"[^\x00-\u0557\u2010-\u2027\u2030-\u205e]")

#: Counts kept per worker; beyond it they are worked out anew.
WORDS_KEPT = 1_000_000
#: Bytes of pre-tokens merged together.
MERGE_BYTES = 4_000_000

_NO_RANK = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """The merge table of a byte-level vocabulary, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocab = model["model"]["vocab"]
        self.special = [t["content"] for t in model["added_tokens"] if t["special"]]
        self.width = np.int64(max(vocab.values()) + 1)
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            self.of_byte[byte] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        left, right, made = (
            np.array([vocab[t] for t in tokens], np.int64)
            for tokens in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs])
        )
        keys = left * self.width + right
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order, made[order]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and new symbol of each pair; no rank where the pair isn't merged."""
        keys = left * self.width + right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == keys
        return np.where(known, self.rank[at], _NO_RANK), self.made[at]

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty sequence of bytes."""
        out = np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        while len(ids):
            same = owner[1:] == owner[:-1]
            rank, made = self.look_up(ids[:-1], ids[1:])
            rank = np.append(np.where(same, rank, _NO_RANK), _NO_RANK)
            starts = np.flatnonzero(np.concatenate(([True], ~same)))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            done = lowest == _NO_RANK
            out[owner[starts[done]]] = sizes[done]
            lowest = np.repeat(lowest, sizes)
            hit = (rank == lowest) & (rank != _NO_RANK)
            hit = every_other(hit)
            where = np.flatnonzero(hit)
            ids[where] = made[where]
            keep = np.repeat(~done, sizes)
            keep[where + 1] = False
            ids, owner = ids[keep], owner[keep]
        return out


def every_other(hit: np.ndarray) -> np.ndarray:
    """Of each run of neighbouring hits (a symbol paired with itself), the first, third, ..."""
    if not (hit[1:] & hit[:-1]).any():
        return hit
    where = np.arange(len(hit))
    begins = hit & ~np.concatenate(([False], hit[:-1]))
    first = np.maximum.accumulate(np.where(begins, where, 0))
    return hit & ((where - first) % 2 == 0)


class Counter:
    """Token counts of whole texts, with the counts of pre-tokens seen before."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.split = regex.compile(SPLIT)
        self.special = regex.compile("|".join(map(regex.escape, self.merges.special))) if self.merges.special else None
        self.pre_tokenizer = Tokenizer.from_file(path).pre_tokenizer
        self.known: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        if UNSURE.search(text):
            return [text[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(text)]
        return self.split.findall(text)

    def count(self, texts: Iterable[str | None]) -> list[int]:
        known = self.known
        out = []
        for text in texts:
            total, parts = 0, [text or ""]
            if self.special is not None:
                parts = self.special.split(parts[0])
                total = len(parts) - 1
            for part in parts:
                words = self.words(part)
                new = [w for w in dict.fromkeys(words) if w not in known]
                self.learn(new)
                total += sum(map(known.__getitem__, words))
                if len(known) > WORDS_KEPT:
                    known.clear()
            out.append(total)
        return out

    def learn(self, words: list[str]) -> None:
        batch, held = [], 0
        for word in words:
            batch.append(word)
            held += len(word)
            if held > MERGE_BYTES:
                self.merge(batch)
                batch, held = [], 0
        self.merge(batch)

    def merge(self, words: list[str]) -> None:
        if words:
            self.known.update(zip(words, self.merges.count([w.encode() for w in words]).tolist()))


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def n_tokens(text: Column | str, path: str) -> Column:
    """Tokens of a text under the byte-level vocabulary at ``path``, a file every worker has.

    A null text has none. Strings of special tokens count as that token, as is the
    tokenizer library's default.
    """

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(counter(path).count(texts), dtype="int64")

    return count(text)


def token_counts(
    docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` per row of ``docs``.

    A null text counts as empty: no bytes, no tokens. Repeated rows, and rows with a null
    id, are counted each; other columns of ``docs`` are left out, so their names can't clash.
    An empty table gives no rows.
    """
    counted = docs.select(
        F.col(id_col),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        n_tokens(text_col, path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
