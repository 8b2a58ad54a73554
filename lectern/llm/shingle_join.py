"""N-gram Jaccard join with filters under several global token orders.

A document's set holds the hashes of its distinct word n-grams. Two sets that are similar
enough share a token among the first few of each, whatever global order the tokens are taken
in. The first order, commonest tokens last, is indexed: tokens of prefixes that lie in two
sets or more make buckets of candidates. What passes the bounds by size and by bitmap must
share prefix tokens under further orders too, for which prefixes are kept beside the sets;
only what passes all filters has its sets fetched, and is verified by exact intersection.

Work on groups of copies stays in proportion to their size. Equal sets are one node. Every
bucket's members are first compared with one of them; members that are connected by then need
no further comparison, and what is left is compared component by component, in blocks.

Tokens are 64-bit hashes of n-grams, and nodes 64-bit hashes of sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.operators.skew import join_per_key
from lectern.session import materialise, scratch

N_WORDS = 5
#: Similarity in percent.
PERCENT = 75
#: Odd multipliers, one per token order.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Tokens are counted in so many cells; the order needs no exact counts, only the same for all.
CELL_BITS = 20
CHUNK = 1 << 12
#: Nodes of a component that are compared with a node at a time.
BLOCK = 64
#: Tokens that count as a node of a block, so that long sets make blocks of few nodes.
NODE_TOKENS = 256
#: List entries that are counted for a component in one row; more are counted as rows.
ENTRIES = 1_000_000
#: Bytes of texts whose words are hashed together.
READ_BYTES = 500_000
#: Keys of up to so many bytes in all are broadcast to pick documents; more are joined.
BROADCAST_BYTES = 16 << 20
#: Bytes of a word hashed together with other words; longer words are hashed one by one.
SHORT_WORD = 64

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STIR = np.uint64(0xD6E8FEB86659FD93)
#: What keeps the first so many bytes of a number in little-endian order.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _combined(hashes: np.ndarray, n_words: int, tag: int = 0) -> np.ndarray:
    """A hash of every run of ``n_words`` hashes."""
    n = len(hashes) - n_words + 1
    out = np.full(n, tag, np.uint64)
    for j in range(n_words):
        out = (out ^ hashes[j : n + j]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def word_hashes(blob: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, eight bytes after the other. Each step is a bijection, so words of
    eight bytes or less have hashes of their own within their length."""
    lengths = ends - starts
    eights = np.ndarray((len(blob),), "<u8", blob + bytes(8), strides=(1,))
    out = lengths.astype(np.uint64) * _MIX
    for j in range(0, SHORT_WORD, 8):
        at = np.flatnonzero(lengths > j)
        if not len(at):
            break
        part = eights[starts[at] + j] & _KEEP[np.minimum(lengths[at] - j, 8)]
        h = (out[at] ^ part) * _STIR
        h = (h ^ (h >> np.uint64(32))) * _MIX
        out[at] = h ^ (h >> np.uint64(29))
    for i in np.flatnonzero(lengths > SHORT_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(blob[starts[i] : ends[i]])
    return out


def _sets(raws: list[bytes], n_words: int) -> list[np.ndarray]:
    blob = b" ".join(raws).translate(_LOWER)
    letters = np.frombuffer(blob, np.uint8)
    gaps = _SPACE[letters]
    edges = np.diff(np.concatenate(([True], gaps, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    words = word_hashes(blob, starts, ends)
    runs = _combined(words, n_words) if len(words) >= n_words else np.empty(0, np.uint64)
    bounds = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raws]))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n_words:
            tokens = np.sort(runs[a : b - n_words + 1])
            out.append(tokens[np.concatenate(([True], tokens[1:] != tokens[:-1]))])
        else:
            out.append(_combined(words[a:b], b - a, b - a) if b > a else np.empty(0, np.uint64))
    return out


def shingle_sets(texts: Iterable[str | None], n_words: int = N_WORDS) -> list[np.ndarray]:
    """The set of each text: sorted distinct hashes of its word n-grams, or of all its words if
    it has fewer. Words are runs other than ASCII white space, with A-Z lower-cased; texts
    are taken together up to some size, and whole."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append((text or "").encode())
        size += len(held[-1]) + 1
        if size >= READ_BYTES:
            out += _sets(held, n_words)
            held, size = [], 0
    return out + (_sets(held, n_words) if held else [])


def node_of(tokens: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(tokens.tobytes()), np.uint64).astype(np.int64))


def cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def prefix_length(n: int, percent: int) -> int:
    """Tokens of a set of n of which a similar one has at least one."""
    return n - -(-n * percent // 100) + 1


def token_classes(counts: np.ndarray) -> np.ndarray:
    """The part of a token's place in an order that comes from how often its cell occurs, in
    half octaves."""
    return (2 * np.log2(np.maximum(counts, 1))).astype(np.uint64) << np.uint64(58)


def prefix(tokens: np.ndarray, classes: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first tokens of a set in a global order: by the class of their cell, then by a hash
    of the order's own. Tokens level with the last one are in it too."""
    mixed = tokens * np.uint64(ORDERS[order])
    mixed ^= mixed >> np.uint64(31)
    key = classes[cells(tokens)] | (mixed >> np.uint64(6))
    last = prefix_length(len(tokens), percent) - 1
    return tokens[key <= np.partition(key, last)[last]]


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit per token in a map of 16 to 32 bits a token, at least 64."""
    bits = max(64, 1 << int(len(tokens) * 16 - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[((tokens * np.uint64(ORDERS[-1])) >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def _folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Rows of a bitmap brought to ``width`` bytes. Places follow the hash's top bits, so a
    place of the small map is a run of places of the large one."""
    if maps.shape[1] == width:
        return maps
    bits = np.unpackbits(maps, axis=1).reshape(len(maps), width * 8, -1).max(axis=2)
    return np.packbits(bits, axis=1)


def may_link(n: int, own: bytes, sizes: np.ndarray, maps: np.ndarray, percent: int) -> np.ndarray:
    """Which of other sets (``sizes``, rows of ``maps``) bitmaps leave room to link with: each
    bit that only one has stands for a token that the other lacks."""
    one = np.frombuffer(own, np.uint8)[None, :]
    width = min(one.shape[1], maps.shape[1])
    one, others = _folded(one, width).view(np.uint64), _folded(maps, width).view(np.uint64)
    common = np.minimum(
        n - np.bitwise_count(one & ~others).sum(axis=1, dtype=np.int64),
        sizes - np.bitwise_count(others & ~one).sum(axis=1, dtype=np.int64),
    )
    fits = 100 * np.minimum(n, sizes) >= percent * np.maximum(n, sizes)
    return fits & (100 * common >= percent * (n + sizes - common))


def may_link_pair(n_a: int, map_a: bytes, n_b: int, map_b: bytes, percent: int) -> bool:
    return bool(may_link(n_a, map_a, np.array([n_b]), np.frombuffer(map_b, np.uint8)[None, :], percent)[0])


def other_prefixes(tokens: np.ndarray, classes: np.ndarray, percent: int) -> list[bytes]:
    """The prefix of a set in every further order, by half of each token: what has none in
    common has no token in common either."""
    found = (prefix(tokens, classes, order, percent) for order in range(1, len(ORDERS)))
    return [(p & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for p in found]


def meet(a: list[bytes], b: list[bytes]) -> bool:
    """Whether prefixes share a token in every order."""
    return all(np.isin(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)).any() for x, y in zip(a, b))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets link."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def few_keys(keys: DataFrame) -> DataFrame:
    """Keys, written, and broadcast up to a number of bytes: ids may be texts of any length."""
    keys = materialise(keys, "shingle-keys")
    size = keys.agg(F.sum(F.octet_length(F.col("key")["id"].cast("string")) + 32)).first()[0]
    return F.broadcast(keys) if (size or 0) <= BROADCAST_BYTES else keys


class ShingleJoin:
    """The steps of one join; all results are written tables."""

    def __init__(self, docs: DataFrame, n_words: int = N_WORDS, percent: int = PERCENT):
        """``docs`` has ``key, text``; keys aren't null, and equal ones have equal texts."""
        self.docs, self.n_words, self.percent = docs, n_words, percent
        self.spark = docs.sparkSession
        self.key_type = docs.schema["key"].dataType.simpleString()
        self.members, counts = self._read()
        # The least key of each class of equal sets, added up before anything is joined by node.
        firsts = self.members.filter("n > 0").groupBy("node").agg(F.min("key").alias("first"))
        self.firsts = materialise(firsts, "shingle-firsts")
        self.classes_of_cells = self.spark.sparkContext.broadcast(token_classes(counts))

    def _read(self) -> tuple[DataFrame, np.ndarray]:
        """Node and size of each document, and the counts of tokens by cell, in one reading."""
        n_words = self.n_words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(1 << CELL_BITS, np.int64)
            keys = pa.null()
            for batch in batches:
                keys = batch.schema.field(0).type
                sets = shingle_sets(batch.column(1).to_pylist(), n_words)
                nodes = [node_of(s) if len(s) else None for s in sets]
                sizes = [len(s) for s in sets]
                n = len(sets)
                if n:
                    counts += np.bincount(cells(np.concatenate(sets)), minlength=len(counts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                    names,
                )
            if not counts.any():
                return
            parts = [(i, counts[i * CHUNK : (i + 1) * CHUNK]) for i in range(len(counts) // CHUNK)]
            parts = [(i, zlib.compress(c.astype("<i8").tobytes(), 1)) for i, c in parts if c.any()]
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, keys), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())],
                names,
            )

        names = ["key", "node", "n", "chunk", "counted"]
        schema = f"key {self.key_type}, node long, n long, chunk int, counted binary"
        read = materialise(self.docs.select("key", "text").mapInArrow(run, schema), "shingles")

        def total(group: pd.DataFrame) -> pd.DataFrame:
            counts = np.zeros(CHUNK, np.int64)
            for part in group["counted"]:
                counts += np.frombuffer(zlib.decompress(part), "<i8")
            return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "counted": [counts.astype("<i8").tobytes()]})

        # A fixed number of cells, whatever the data: 8 MB.
        counts = np.zeros(1 << CELL_BITS, np.int64)
        summed = read.filter("chunk IS NOT NULL").select("chunk", "counted")
        for row in summed.groupBy("chunk").applyInPandas(total, "chunk int, counted binary").collect():
            counts[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counted"], "<i8")
        return read.filter("chunk IS NULL").select("key", "node", "n"), counts

    def _postings(self, docs: DataFrame) -> DataFrame:
        """``token, node, n``: prefixes in the first order, with the size of the set."""
        n_words, percent, classes = self.n_words, self.percent, self.classes_of_cells

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = {node_of(s): s for s in shingle_sets(batch.column(0).to_pylist(), n_words) if len(s)}
                if sets:
                    found = [prefix(s, classes.value, 0, percent) for s in sets.values()]
                    counts = [len(f) for f in found]
                    columns = (
                        np.concatenate(found).view(np.int64),
                        np.repeat(np.array(list(sets), np.int64), counts),
                        np.repeat(np.array([len(s) for s in sets.values()], np.int64), counts),
                    )
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "n"])

        return docs.select("text").mapInArrow(run, "token long, node long, n long")

    def _shared(self) -> DataFrame:
        """``token, node, n`` of the tokens that lie in the prefixes of two documents or more,
        of which only one of each class of equal sets is read."""
        copies = self.members.filter("n > 0").join(self.firsts, "node").filter("key <> first").select("key").distinct()
        docs = self.docs.join(few_keys(copies), "key", "left_anti")
        # What is joined is written first, so that both sides are plain and hot keys are split.
        tokens = self._postings(docs).groupBy("token").agg(F.count("*").alias("docs")).filter("docs > 1")
        tokens = materialise(tokens.select("token"), "shingle-tokens")
        return materialise(self._postings(docs).join(tokens, "token"), "shingle-postings")

    def _texts(self, nodes: DataFrame) -> DataFrame:
        """``text`` of one document of each given node."""
        chosen = self.firsts.join(nodes.select("node").distinct(), "node", "left_semi")
        chosen = few_keys(chosen.select(F.col("first").alias("key")).distinct())
        return self.docs.select("key", "text").join(chosen, "key", "left_semi").select("text")

    def _picked(self, nodes: DataFrame) -> DataFrame:
        """``node, n, bits, others, tokens``: sets of the given nodes, each read from one
        document, with their bitmaps and their prefixes in the further orders."""
        n_words, percent, classes = self.n_words, self.percent, self.classes_of_cells
        docs = self._texts(nodes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [s for s in shingle_sets(batch.column(0).to_pylist(), n_words) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([node_of(s) for s in sets], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([bitmap(s) for s in sets], pa.binary()),
                        pa.array([other_prefixes(s, classes.value, percent) for s in sets], pa.list_(pa.binary())),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    ["node", "n", "bits", "others", "tokens"],
                )

        schema = "node long, n long, bits binary, others array<binary>, tokens binary"
        sets = materialise(docs.mapInArrow(run, schema), "shingle-sets")
        # Keys of several rows may name a node twice.
        if sets.groupBy("node").count().filter("count > 1").isEmpty():
            return sets
        return materialise(sets.dropDuplicates(["node"]), "shingle-sets")

    def _plausible(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs ``u, v`` whose sizes and bitmaps leave room for a link, and whose prefixes
        meet in every order; the sets themselves are not read."""
        percent = self.percent
        narrow = sets.select("node", F.struct("n", "bits", "others").alias("of"))
        side = lambda c: narrow.select(F.col("node").alias(c), F.col("of").alias(f"{c}_set"))

        @F.arrow_udf("boolean")
        def room(n_u: pa.Array, map_u: pa.Array, of_u: pa.Array, n_v: pa.Array, map_v: pa.Array, of_v: pa.Array) -> pa.Array:
            rows = zip(*(c.to_pylist() for c in (n_u, map_u, n_v, map_v)))
            return pa.array(
                [may_link_pair(*row, percent) and meet(a.as_py(), b.as_py()) for row, a, b in zip(rows, of_u, of_v)],
                pa.bool_(),
            )

        both = pairs.join(side("u"), "u").join(side("v"), "v")
        a, b = F.col("u_set"), F.col("v_set")
        fits = F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * percent
        passes = room(a["n"], a["bits"], a["others"], b["n"], b["bits"], b["others"])
        return both.filter(fits).filter(passes).select("u", "v")

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs ``u, v`` that link."""
        percent = self.percent
        side = lambda c: sets.select(F.col("node").alias(c), F.col("tokens").alias(f"{c}_tokens"))

        @F.arrow_udf("boolean")
        def link(a: pa.Array, b: pa.Array) -> pa.Array:
            rows = ((np.frombuffer(x.as_buffer(), np.uint64) for x in row) for row in zip(a, b))
            return pa.array([similar(*row, percent) for row in rows], pa.bool_())

        both = pairs.join(side("u"), "u").join(side("v"), "v")
        return both.filter(link("u_tokens", "v_tokens")).select("u", "v")

    def links(self) -> DataFrame:
        """``u, v``: links that connect all nodes that links connect."""
        found = self._shared()
        leaders = materialise(found.groupBy("token").agg(F.min("node").alias("leader")), "shingle-leaders")
        shared = found.groupBy("node", "n").agg(F.count("*").alias("tokens"))
        shared = materialise(shared.select("node", F.struct("n", "tokens").alias("of")), "shingle-shared")
        pairs = found.join(leaders, "token").filter("leader < node").select("leader", "node").distinct()
        pairs = pairs.select(F.col("leader").alias("u"), F.col("node").alias("v"))
        for side in ("u", "v"):
            pairs = pairs.join(shared.select(F.col("node").alias(side), F.col("of").alias(f"of_{side}")), side)
        a, b = F.col("of_u"), F.col("of_v")
        fits = self._room(F.least(a["tokens"], b["tokens"]), a["n"], a["n"], b["n"], b["n"])
        first = self._linked(materialise(pairs.filter(fits).select("u", "v"), "shingle-pairs"))
        labels = materialise(components(first), "shingle-components")
        more = self._between(found, labels)
        return materialise(first.unionByName(more).distinct(), "shingle-links")

    def _room(self, common: Column, low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
        """Whether two sets of sizes in the given ranges may link when their prefixes have at
        most ``common`` tokens in common.

        Of the two prefixes, one ends first in the order; what the sets have in common lies in
        both prefixes, or after the one that ends first. So the intersection is at most
        ``common`` and the rest of that set.
        """
        percent = self.percent
        rest = F.ceil(F.greatest(high_a, high_b) * percent / F.lit(100)) - 1
        sizes = (high_a * 100 >= low_b * percent) & (high_b * 100 >= low_a * percent)
        return sizes & ((common + rest) * (100 + percent) >= (low_a + low_b) * percent)

    def _linked(self, pairs: DataFrame) -> DataFrame:
        both = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))
        sets = self._picked(both)
        pairs = materialise(self._plausible(pairs, sets), "shingle-pairs")
        return materialise(self._verified(pairs, sets), "shingle-links")

    def _between(self, found: DataFrame, labels: DataFrame) -> DataFrame:
        """Links between nodes of different components that meet in a bucket."""
        percent = self.percent
        nodes = found.select("node", "n").distinct().join(labels, "node", "left")
        nodes = materialise(nodes.withColumn("comp", F.coalesce("label", "node")).drop("label"), "shingle-nodes")
        weight = F.greatest(F.count("*"), F.ceil(F.sum("n") / NODE_TOKENS))
        comps = nodes.groupBy("comp").agg(F.min("n").alias("low"), F.max("n").alias("high"), weight.alias("size"))
        comps = materialise(comps, "shingle-comps")

        met = materialise(
            found.join(nodes.select("node", "comp"), "node").select("token", "comp").distinct(), "shingle-met"
        )
        mixed = met.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("met"))
        mixed = materialise(mixed.filter("a < b").select("token", "met"), "shingle-mixed")
        met = materialise(met.join(mixed, "token").join(comps, "comp"), "shingle-met")
        meetings = materialise(self._meetings(met), "shingle-meetings")

        asked = meetings.select(F.col("from").alias("comp")).unionByName(meetings.select("comp")).distinct()
        sets = self._picked(nodes.join(asked, "comp", "left_semi"))
        placed = sets.select("node", "n", "bits").join(nodes.select("node", "comp"), "node")
        placed = materialise(placed, "shingle-placed")

        def blocks(size: Column) -> Column:
            return F.ceil(size / BLOCK).cast("int")

        dealt = placed.join(comps.select("comp", "size"), "comp")
        dealt = dealt.withColumn("block", F.pmod(F.hash("node"), blocks(F.col("size"))))
        dealt = dealt.groupBy(F.col("comp").alias("to"), "block").agg(
            F.collect_list("node").alias("nodes"), F.collect_list("n").alias("sizes"), F.collect_list("bits").alias("maps")
        )
        dealt = materialise(dealt, "shingle-blocks")

        @F.arrow_udf("array<long>")
        def partners(n: pa.Array, bits: pa.Array, nodes: pa.Array, sizes: pa.Array, maps: pa.Array) -> pa.Array:
            out = []
            for row in zip(n.to_pylist(), bits.to_pylist(), nodes, sizes, maps):
                size, own, names, counts, raw = row[0], row[1], *(c.as_py() for c in row[2:])
                found = []
                for width in set(map(len, raw)):
                    at = [i for i, r in enumerate(raw) if len(r) == width]
                    others = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), width)
                    fits = may_link(size, own, np.array([counts[i] for i in at]), others, percent)
                    found += [names[at[k]] for k in np.flatnonzero(fits)]
                out.append(found)
            return pa.array(out, pa.list_(pa.int64()))

        asked = meetings.join(placed.withColumnRenamed("comp", "from"), "from").select(
            "node", "n", "bits", F.col("comp").alias("to"), F.explode(F.sequence(F.lit(0), blocks(F.col("size")) - 1)).alias("block")
        )
        pairs = asked.join(dealt, ["to", "block"]).select(
            F.col("node").alias("u"), F.explode(partners("n", "bits", "nodes", "sizes", "maps")).alias("v")
        )
        pairs = materialise(self._plausible(pairs.distinct(), sets), "shingle-pairs")
        return self._verified(pairs, sets)

    def _meetings(self, met: DataFrame) -> DataFrame:
        """``from, comp, size``: pairs of components that share tokens enough to have a link; the
        smaller one is first. Other components of a bucket come as lists, in blocks, and are
        counted per component, so that pairs without room are never rows; a component with very
        many entries has them counted as rows, so that none gathers them all."""
        percent = self.percent
        block = F.pmod(F.hash("comp"), F.ceil(F.col("met") / BLOCK).cast("int")).alias("block")
        member = F.struct("comp", "size", "low", "high")
        blocks = met.groupBy("token", block).agg(F.collect_list(member).alias("others"))
        blocks = materialise(blocks.select("token", "others"), "shingle-blocks")
        larger = F.filter(
            "others",
            lambda o: (F.struct("size", "comp") < F.struct(o["size"], o["comp"]))
            & (F.col("high") * 100 >= o["low"] * percent)
            & (o["high"] * 100 >= F.col("low") * percent),
        )
        entries = met.groupBy("comp").agg(F.sum("met").alias("entries")).filter(F.col("entries") > ENTRIES)
        many = materialise(entries.select("comp"), "shingle-many")

        def others_of(part: DataFrame) -> DataFrame:
            return part.join(blocks, "token").select("comp", "low", "high", larger.alias("others")).filter(F.size("others") > 0)

        rows = others_of(met.join(many, "comp")).select("comp", "low", "high", F.explode("others").alias("to"))
        rows = rows.groupBy("comp", "low", "high", "to").agg(F.count("*").alias("common"))
        fits = self._room(F.col("common"), F.col("low"), F.col("high"), F.col("to.low"), F.col("to.high"))
        rows = rows.filter(fits).select(F.col("comp").alias("from"), "to.comp", "to.size")
        lists = others_of(met.join(many, "comp", "left_anti")).groupBy("comp", "low", "high")
        lists = lists.agg(F.collect_list("others").alias("lists"))

        @F.arrow_udf("array<struct<comp:long,size:long>>")
        def with_room(low: pa.Array, high: pa.Array, lists: pa.Array) -> pa.Array:
            out = []
            for low_a, high_a, row in zip(low.to_pylist(), high.to_pylist(), lists):
                flat = row.values.flatten()
                comp, size, low_b, high_b = (flat.field(n).to_numpy() for n in ("comp", "size", "low", "high"))
                _, first, common = np.unique(comp, return_index=True, return_counts=True)
                rest = -(-np.maximum(high_a, high_b[first]) * percent // 100) - 1
                fits = (common + rest) * (100 + percent) >= (low_a + low_b[first]) * percent
                out.append([{"comp": int(comp[i]), "size": int(size[i])} for i in first[fits]])
            return pa.array(out, pa.list_(pa.struct([("comp", pa.int64()), ("size", pa.int64())])))

        found = lists.select(F.col("comp").alias("from"), F.explode(with_room("low", "high", "lists")).alias("to"))
        return found.select("from", "to.comp", "to.size").unionByName(rows)

    def classes(self) -> DataFrame:
        """``key, n, component``: for each document the least key it reaches by links, itself
        included, which is its own without a set."""
        labels = materialise(components(self.links()), "shingle-components")
        least = self.firsts.withColumnRenamed("first", "key")
        least = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = materialise(least, "shingle-least")
        component = materialise(least.groupBy("label").agg(F.min("key").alias("component")), "shingle-component")
        of_node = materialise(least.join(component, "label").select("node", "component"), "shingle-classes")
        out = join_per_key(self.members, of_node, ["node"])
        return out.select("key", "n", F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component")).alias("component"))


def row_key(id_: Column, kind: str, text: Column) -> Column:
    """Names a row by its id, null last, and its text; without nulls."""
    return F.struct(
        id_.isNull().alias("missing"),
        F.coalesce(id_, F.lit("0").cast(kind)).alias("id"),
        F.xxhash64(text).alias("hash"),
    )


def shingle_join(
    docs: DataFrame, n_words: int = N_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, n_shingles, component_id`` per row of ``docs``.

    ``component_id`` is the least id reachable by links between sets of similarity ``percent``
    or more, the row's own included. A null text, or one without words, has an empty set and
    links with nothing. Repeated rows are one class. Rows with a null id link like others but
    name no component unless all of it is null. Other columns of ``docs`` are left out. An
    empty table gives no rows.
    """
    key = row_key(F.col(id_col), docs.schema[id_col].dataType.simpleString(), F.col(text_col))

    def id_of(key: str) -> Column:
        return F.when(~F.col(key)["missing"], F.col(key)["id"])

    with scratch(docs.sparkSession) as kept:
        found = ShingleJoin(docs.select(key.alias("key"), F.col(text_col).alias("text")), n_words, percent).classes()
        return kept(
            found.select(
                id_of("key").alias(id_col), F.col("n").alias("n_shingles"), id_of("component").alias("component_id")
            ),
            "shingle-components",
        )


def one_of_each(
    docs: DataFrame,
    n_words: int = N_WORDS,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with one row of each component: that of the least id, null last. Rows without
    words all stay; of rows equal in id and text, one does."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = rows.withColumn("key", row_key(F.col("row")[id_col], kind, F.col("row")[text_col]))
    with scratch(docs.sparkSession) as kept:
        found = ShingleJoin(rows.select("key", F.col("row")[text_col].alias("text")), n_words, percent).classes()
        found = kept(found.filter("n > 0"), "shingle-classes")

    copies = few_keys(found.filter("component <> key").select("key").distinct())
    again = found.filter("component = key").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    again = few_keys(again.select("key"))
    rows = rows.join(copies, "key", "left_anti")
    once = rows.join(again, "key", "left_anti").select("row")
    first = rows.join(again, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(first).select("row.*")


#: The components in SQL, by counting all shared n-grams of all pairs; for small tables.
SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
         lambda x: x <> '') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {N_WORDS} THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - {N_WORDS - 2}), lambda i: array_to_string(w[i:i + {N_WORDS - 1}], ' ')) END) AS g
  FROM words),
sizes AS (SELECT words.doc_id, count(g) AS n FROM words LEFT JOIN grams USING (doc_id) GROUP BY words.doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= {PERCENT} * (p.n + q.n - count(*))),
reach AS (
  SELECT doc_id AS d, doc_id AS r FROM words
  UNION SELECT reach.d, links.y FROM reach JOIN links ON links.x = reach.r)
SELECT sizes.doc_id, n AS n_shingles, min(r) AS component_id
FROM sizes JOIN reach ON d = sizes.doc_id GROUP BY sizes.doc_id, n
"""
