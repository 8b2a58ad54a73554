"""Removal of byte strings that occur more than once, by sorted suffixes.

A string of the given length has one anchor: the place of its least gram, by hash. Equal
strings have equal anchors, so only strings whose anchor gram occurs again can repeat. The
strings of a document that share an anchor follow each other; with the bytes they cover they
are a region. Equal regions are one, and if there are two of them all their strings repeat.
Different regions of one gram are sorted together, suffix by suffix, and strings that agree
with a neighbour over the whole length repeat.

Grams with many regions, as at the edges of a passage that many documents share, are split
by what parts of their regions have in common, in steps down to single strings, which are
then only counted. So no task ever sorts more than a bounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.suffixes import Hashes, mixed, repeated_places
from lectern.operators.skew import join_per_key
from lectern.session import materialise, scratch

LENGTH = 400
#: Bytes of an anchor gram.
GRAM = 192
#: Regions of a gram that are sorted together; grams with more are split.
GROUP = 256
#: Strings of a part of a region, step by step.
SPLITS = (32, 8, 1)
#: Bytes sorted at a time: whole groups up to about this many.
SORT_BYTES = 400_000

_PLACE = np.uint64(0xFFFFFF)
#: Starts of strings looked at together; places in it must fit in ``_PLACE``.
_PART = 1 << 22


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def hashed(*parts: bytes) -> int:
    return int(signed(np.array([xxhash.xxh3_64_intdigest(b"|".join(parts))], np.uint64))[0])


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of every run of ``width`` keys."""
    n = len(keys)
    filled = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    filled[:n] = keys
    blocks = filled.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - width + 1
    return np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts])


def regions(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Gram, content hash, start, number of strings, and place of the anchor in it, of each
    region of a document."""
    n = len(raw)
    found = []
    for part in range(0, max(0, n - length + 1), _PART):
        piece = np.frombuffer(raw, np.uint8)[part : part + _PART + length - 1].astype(np.int64) + 1
        if len(piece) < length:
            break
        hashes = Hashes(piece)
        grams = mixed(hashes.of(np.arange(len(piece) - gram + 1), gram))
        keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        anchor = (window_minima(keys, length - gram + 1) & _PLACE).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        strings = np.diff(np.append(start, len(anchor)))
        content = mixed(hashes.of(start, strings + length - 1)) ^ strings.astype(np.uint64)
        found.append((signed(grams[anchor[start]]), signed(content), start + part, strings, anchor[start] - start))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*found))


def alike(found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Regions of a document with equal ones taken together: gram, content hash, number of
    strings, place of the anchor, and how many there are; then all starts, in that order."""
    grams, contents, starts, strings, anchors = found
    order = np.lexsort((starts, contents, grams))
    g, c = grams[order], contents[order]
    first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (c[1:] != c[:-1]))))
    same = np.diff(np.append(first, len(order)))
    one = order[first]
    return grams[one], contents[one], strings[one], anchors[one], same, starts[order]


def runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """Start and length of each run of marks."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])]


def covered(starts: np.ndarray, lengths: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Spans of bytes covered by strings that start in the given runs."""
    order = np.argsort(starts, kind="stable")
    begin = starts[order]
    end = np.maximum.accumulate(begin + lengths[order] - 1 + length)
    apart = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
    return list(zip(begin[apart].tolist(), end[np.append(apart[1:] - 1, len(end) - 1)].tolist()))


class Repeats:
    """The steps of one removal; ``docs`` has ``key, text`` with equal keys for equal texts only."""

    def __init__(self, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP):
        if not 0 < gram <= length:
            raise ValueError("a gram is a part of a string")
        self.docs, self.length, self.gram, self.group = docs, length, gram, group

    def _regions(self) -> DataFrame:
        """A row per document and different region: ``key, gram, content, strings, anchor``,
        ``same``, how often the document has it, and ``starts``."""
        length, gram = self.length, self.gram
        names = ["gram", "content", "strings", "anchor", "same"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, parts = [], []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    found = regions((text.as_py() or "").encode(), length, gram)
                    if len(found[0]):
                        parts.append(alike(found))
                        keys.append(np.full(len(parts[-1][0]), key, np.int64))
                if not parts:
                    continue
                *columns, starts = (np.concatenate(c) for c in zip(*parts))
                offsets = np.concatenate(([0], np.cumsum(columns[-1]))).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(starts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), *map(pa.array, columns), listed], ["key", *names, "starts"]
                )

        schema = ", ".join(f"{n} long" for n in ["key", *names])
        return self.docs.mapInArrow(run, f"{schema}, starts array<long>")

    def _again(self) -> DataFrame:
        """Regions whose gram occurs again."""
        grams = self._regions().groupBy("gram").agg(F.sum("same").alias("n")).filter("n > 1").select("gram")
        # Written, so that both sides of the join are plain and a hot gram's rows are split.
        return materialise(self._regions().join(materialise(grams, "repeat-grams"), "gram"), "repeat-regions")

    def _texts(self, wanted: DataFrame) -> DataFrame:
        """``id, content, strings, anchor, bytes`` of ``wanted`` regions (also ``key, start``)."""
        length = self.length
        places = F.struct("start", "strings", "anchor", "id", "content")
        cuts = wanted.groupBy("key").agg(F.collect_list(places).alias("cuts"))
        fields = ("id", "content", "strings", "anchor")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for text, cut in zip(batch.column(0), batch.column(1)):
                    raw = (text.as_py() or "").encode()
                    for c in cut.as_py():
                        end = c["start"] + c["strings"] + length - 1
                        rows.append((*(c[f] for f in fields), raw[c["start"] : end]))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], [*fields, "bytes"]
                )

        docs = self.docs.dropDuplicates(["key"]) if self.repeated_keys else self.docs
        rows = docs.join(cuts, "key").select("text", "cuts")
        return rows.mapInArrow(run, "id long, content long, strings long, anchor long, bytes binary")

    def _sorted(self, units: DataFrame) -> DataFrame:
        """``id, content, at, n``: runs of strings of units (``id, content, bytes``) that occur
        again among the units of their id."""
        length = self.length

        def solve(batch: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            rows = []
            for (id_, content, _), marks in zip(batch, repeated_places([b for _, _, b in batch], length)):
                rows += [(id_, content, at, n) for at, n in runs(marks)]
            columns = list(zip(*rows)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "content", "at", "n"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, last = [], 0, None
            for batch in batches:
                for id_, content, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    if id_ != last and size >= SORT_BYTES:
                        yield solve(held)
                        held, size = [], 0
                    held.append((id_, content, raw.as_py()))
                    size += len(held[-1][2])
                    last = id_
            if held:
                yield solve(held)

        dealt = units.select("id", "content", "bytes").repartition("id").sortWithinPartitions("id")
        return dealt.mapInArrow(run, "id long, content long, at long, n long")

    def _split(self, units: DataFrame, size: int) -> DataFrame:
        """Parts of units with ``size`` strings at most, aligned to their anchors: their id is
        the hash of what all strings of such a part have in common."""
        length = self.length
        names = ["from_id", "from_content", "at", "id", "content", "strings", "anchor", "bytes"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for id_, content, strings, anchor, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    offsets = (anchor - np.arange(strings)) // size
                    edges = np.flatnonzero(np.diff(offsets)) + 1
                    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), strings]):
                        j = int(offsets[a])
                        begin = anchor - size * j
                        common = raw[begin : max(begin, begin - size + 1 + length)]
                        part = raw[a : b - 1 + length]
                        tag = b"%d %d %d" % (id_, size, j)
                        rows.append(
                            (id_, content, a, hashed(tag, common), hashed(b"%d" % (anchor - a), part), b - a, anchor - a, part)
                        )
                columns = list(zip(*rows)) or [[]] * 8
                types = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        schema = ", ".join(f"{n} {'binary' if n == 'bytes' else 'long'}" for n in names)
        rows = units.select("id", "content", "strings", "anchor", "bytes").repartition("content")
        return rows.mapInArrow(run, schema)

    def _among(self, units: DataFrame, splits: tuple[int, ...]) -> DataFrame:
        """``id, content, at, n`` of distinct units, sorted together or, where an id has too
        many, split."""
        sizes = units.groupBy("id").agg(F.count("*").alias("units"))
        few = sizes.filter(F.col("units") <= self.group).select("id")
        many = materialise(sizes.filter(F.col("units") > self.group).select("id"), "repeat-many")
        found = materialise(self._sorted(units.join(few, "id")), "repeat-sorted")
        if not splits or many.isEmpty():
            return found
        size, *rest = splits
        parts = materialise(self._split(units.join(many, "id"), size), "repeat-parts")
        alike = parts.groupBy("id", "content").agg(F.count("*").alias("same"))
        kinds = alike.groupBy("id").agg(F.count("*").alias("kinds"))
        whole = alike.filter("same > 1").select("id", "content")
        whole = parts.join(whole, ["id", "content"]).select("from_id", "from_content", "at", F.col("strings").alias("n"))
        out = found.unionByName(
            whole.select(F.col("from_id").alias("id"), F.col("from_content").alias("content"), "at", "n")
        )
        if size == 1:
            return out
        # Of equal parts one is looked into.
        differing = parts.join(kinds.filter("kinds > 1").select("id"), "id")
        one = differing.dropDuplicates(["id", "content"]).select("id", "content", "strings", "anchor", "bytes")
        inner = self._among(materialise(one, "repeat-units"), tuple(rest))
        inner = inner.select("id", "content", F.col("at").alias("inside"), "n")
        inside = parts.select("from_id", "from_content", "at", "id", "content").join(inner, ["id", "content"])
        inside = inside.select(
            F.col("from_id").alias("id"), F.col("from_content").alias("content"), (F.col("at") + F.col("inside")).alias("at"), "n"
        )
        return materialise(out.unionByName(inside), "repeat-parts")

    def spans(self) -> DataFrame:
        """``key, spans``: of each document with repeated strings, the spans of bytes they
        cover, in order and apart."""
        length = self.length
        keys = self.docs.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        self.repeated_keys = not keys.isEmpty()
        again = self._again()
        first = F.min(F.struct("key", F.get("starts", F.lit(0)).alias("start"), "strings", "anchor"))
        kinds = again.groupBy("gram", "content").agg(F.sum("same").alias("same"), first.alias("first"))
        kinds = materialise(kinds, "repeat-kinds")
        grams = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("gram")
        wanted = kinds.join(grams, "gram").select(F.col("gram").alias("id"), "content", "first.*")
        units = materialise(self._texts(materialise(wanted, "repeat-wanted")), "repeat-units")
        found = self._among(units, SPLITS)

        whole = kinds.filter("same > 1").select("gram", "content", F.lit(None).cast("array<struct<at:long,n:long>>").alias("parts"))
        part = found.groupBy("id", "content").agg(F.collect_set(F.struct("at", "n")).alias("parts"))
        part = part.withColumnRenamed("id", "gram").join(whole.select("gram", "content"), ["gram", "content"], "left_anti")
        verdicts = materialise(whole.unionByName(part), "repeat-verdicts")
        found = again.join(verdicts, ["gram", "content"]).select(
            "key", "gram", "content",
            F.struct("starts", F.coalesce("parts", F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("strings").alias("n")))).alias("parts")).alias("run"),
        )

        @F.arrow_udf("array<struct<start:long,end:long>>")
        def cover(column: pa.Array) -> pa.Array:
            out = []
            for row in column:
                starts, lengths = [], []
                for run in row.as_py():
                    at = np.array(run["starts"], np.int64)
                    for part in run["parts"]:
                        starts.append(at + part["at"])
                        lengths.append(np.full(len(at), part["n"]))
                spans = covered(np.concatenate(starts), np.concatenate(lengths), length)
                out.append([{"start": a, "end": b} for a, b in spans])
            return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

        if self.repeated_keys:
            # Rows that are equal have equal runs, however many they are.
            found = found.groupBy("key", "gram", "content").agg(F.any_value("run").alias("run"))
        rows = found.groupBy("key").agg(F.collect_list("run").alias("runs"))
        return rows.select("key", cover("runs").alias("spans"))


def kept_bytes(text: str | None, spans: list[dict] | None) -> bytes:
    raw = (text or "").encode()
    if not spans:
        return raw
    parts, at = [], 0
    for s in spans:
        parts.append(raw[at : s["start"]])
        at = s["end"]
    return b"".join([*parts, raw[at:]])


def without_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, n_bytes, spans, kept`` per row of ``docs``: the spans of UTF-8 bytes covered
    by strings of ``length`` bytes that also start anywhere else, the same document included,
    and the bytes left, in order.

    A null text is empty. Repeated rows repeat each other's strings. Texts shorter than
    ``length`` stay as they are. Other columns of ``docs`` are left out. An empty table gives
    no rows.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = narrow.withColumn("key", F.xxhash64("id", "text"))
    with scratch(docs.sparkSession) as kept:
        spans = kept(Repeats(keyed.select("key", "text"), length, gram).spans(), "repeat-spans")

    @F.arrow_udf("binary")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([kept_bytes(t.as_py(), s.as_py()) for t, s in zip(texts, found)], pa.binary())

    rows = join_per_key(keyed, spans, ["key"])
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    none = F.array().cast("array<struct<start:long,end:long>>")
    some = F.col("spans").isNotNull()
    return rows.select(
        F.col("id").alias(id_col),
        F.octet_length(raw).cast("long").alias("n_bytes"),
        F.coalesce("spans", none).alias("spans"),
        F.when(some, cut("text", "spans")).otherwise(raw).alias("kept"),
    )
