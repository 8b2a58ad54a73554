"""A quality score: regularised quadratic discriminant over transformed document statistics.

Statistics of whole texts are transformed towards normal shape. Each class is a Gaussian with
its own covariance, shrunk towards the pooled diagonal; the score comes from the difference
of Mahalanobis log-densities, by Cholesky factors that are made and inverted once. Sums for
the means and covariances run over all labelled rows, and a logistic curve fitted to counts
of the differences turns them into probabilities.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import materialise

#: Share of the pooled diagonal in each class covariance, and what is added to the diagonal.
SHRINKAGE = 0.1
RIDGE = 1e-3
#: Width of the bins over which differences are counted for the logistic curve.
BIN = 0.05

NAMES = (
    "chars", "words", "word_length", "word_spread", "line_words", "upper", "digits", "marks", "symbols", "spaces",
    "ends", "commas", "beyond_ascii", "distinct", "top", "repeats", "pairs", "lines_again", "marked", "entropy",
    "squeeze", "bars", "capitals",
)

_MARKED = re.compile(rb"[^A-Za-z0-9\x80-\xff\x20\x09-\x0d.,][\x20\x09-\x0d]")
_CAPITAL = re.compile(rb"(?:^|[\x20\x09-\x0d])[A-Z][A-Z]")

_BYTE = np.arange(256)
_CLASSES = np.stack(
    [
        np.isin(_BYTE, np.frombuffer(members, np.uint8))
        for members in (
            b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
            b"0123456789",
            b"!?;:'\"()-",
            b"#$%&*+/<=>@[\\]^_`{}~",
            b" \t\n\r\x0b\x0c",
            b".",
            b",",
            bytes(range(128, 256)),
            b"|",
        )
    ]
).astype(np.float64)


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text: logarithms of sizes, square roots of shares."""
    raw = (text or "").encode()
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    upper, digits, marks, symbols, spaces, ends, commas, beyond, bars = (_CLASSES @ counts / max(n, 1)).tolist()
    share = counts[counts > 0] / max(n, 1)
    entropy = float(-(share * np.log2(share)).sum())
    words = raw.lower().split()
    k = max(len(words), 1)
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    lengths = np.fromiter(map(len, codes), np.int64, len(codes))[ids] if len(ids) else np.zeros(1)
    often = np.bincount(ids) if len(ids) else np.zeros(1)
    pairs = ids[:-1] * len(codes) + ids[1:]
    again = float((ids[:-1] == ids[1:]).mean()) if len(pairs) else 0.0
    pair_share = len(np.unique(pairs)) / len(pairs) if len(pairs) else 1.0
    lines = [line for line in raw.split(b"\n") if line.strip()]
    squeezed = len(zlib.compress(raw, 1)) / (n + 16)
    root = math.sqrt
    return [
        math.log1p(n),
        math.log1p(len(words)),
        math.log1p(float(lengths.mean())),
        math.log1p(float(lengths.std())),
        math.log1p(len(words) / max(len(lines), 1)),
        root(upper),
        root(digits),
        root(marks),
        root(symbols),
        root(spaces),
        root(ends),
        root(commas),
        root(beyond),
        root(len(codes) / k),
        root(float(often.max()) / k),
        root(again),
        root(1.0 - pair_share),
        root(1.0 - len(set(lines)) / max(len(lines), 1)),
        root(len(_MARKED.findall(raw)) / k),
        entropy,
        root(squeezed),
        root(bars),
        root(len(_CAPITAL.findall(raw)) / k),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, stats`` per row; a null text counts as empty."""
    key_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], ["key", "stats"])

    narrow = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"key {key_type}, stats array<double>").withColumnRenamed("key", id_col)


@dataclass(frozen=True)
class Model:
    """Means and inverse Cholesky factors by class, and the curve from differences to scores."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, stats: np.ndarray) -> np.ndarray:
        """asinh of log-density under class 1 less that under class 0."""
        logs = []
        for c in (0, 1):
            z = (stats - self.means[c]) @ self.factors[c].T
            logs.append(self.offsets[c] - 0.5 * (z**2).sum(axis=1))
        return np.arcsinh(logs[1] - logs[0])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.difference(stats) + self.shift, -500, 500)))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products of the statistics by class, from ``label, stats``.

    Each batch gives one row per class and moment; those are summed in Spark, so the driver
    gets a fixed number of rows.
    """
    d = len(NAMES)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            stats = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for c in (0, 1):
                x = stats[labels == c]
                if len(x):
                    sums[c] = sums.get(c, 0) + np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x)[upper]))
        for c, values in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()), pa.array(values)],
                ["label", "place", "value"],
            )

    rows = (
        labelled.mapInArrow(run, "label int, place int, value double")
        .groupBy("label", "place")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    out = {}
    for c in {r["label"] for r in rows}:
        values = np.zeros(1 + d + len(upper[0]))
        for r in rows:
            if r["label"] == c:
                values[r["place"]] = r["value"]
        products = np.zeros((d, d))
        products[upper] = values[1 + d :]
        products = products + np.triu(products, 1).T
        out[c] = (values[0], values[1 : 1 + d], products)
    return out


def discriminant(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float, ridge: float) -> Model:
    d = len(NAMES)
    total = sum(n for n, _, _ in sums.values())
    means = np.stack([sums[c][1] / sums[c][0] for c in (0, 1)])
    spread = [sums[c][2] / sums[c][0] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = np.diag(sum(np.diag(s) * sums[c][0] / total for c, s in enumerate(spread)))
    factors, offsets = [], []
    for c in (0, 1):
        shrunk = (1 - shrinkage) * spread[c] + shrinkage * pooled + ridge * np.eye(d)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        offsets.append(math.log(sums[c][0] / total) - np.log(np.diag(lower)).sum())
    return Model(means, np.stack(factors), np.array(offsets))


def curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and shift of a logistic curve over ``(difference, rows, rows of class 1)``, by
    Newton's method. Its targets lie inside 0 and 1 by one row of each class, so that classes
    which are apart don't make it a step."""
    x = np.array([b[0] for b in bins])
    n = np.array([b[1] for b in bins], float)
    good = np.array([b[2] for b in bins], float)
    y = good * (good.sum() + 1) / (good.sum() + 2) + (n - good) / ((n - good).sum() + 2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - n * p) - 1e-6 * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fit(labelled: DataFrame, shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Model | None:
    """A model from ``label, stats``; labels other than 0 and 1 are left out. None if a class
    has fewer than two rows."""
    rows = labelled.filter("label IN (0, 1)").select(F.col("label").cast("int").alias("label"), "stats")
    sums = moments(rows)
    if any(sums.get(c, (0,))[0] < 2 for c in (0, 1)):
        return None
    model = discriminant(sums, shrinkage, ridge)
    bins = (
        rows.select("label", F.round(difference(model, "stats") / BIN).alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.sum("label").alias("good"))
        .collect()
    )
    slope, shift = curve([(r["bin"] * BIN, r["n"], r["good"]) for r in bins])
    return Model(model.means, model.factors, model.offsets, slope, shift)


def _matrix(stats: pa.Array) -> np.ndarray:
    return stats.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def difference(model: Model, stats: Column | str) -> Column:
    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        return pa.array(model.difference(_matrix(values)))

    return run(stats)


def scores(model: Model | None, stats: Column | str) -> Column:
    """Probability of label 1; one half without a model."""
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(values)))

    return run(stats)


def text_scores(model: Model | None, text: Column | str) -> Column:
    """As ``scores``, straight from texts."""
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array([statistics(t.as_py()) for t in texts]).reshape(-1, len(NAMES))))

    return run(text)


def held_out(key: Column | str) -> Column:
    """Rows kept from training: one id in four, by crc32 of the id as text. A null id isn't."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``label, stats`` of labelled rows outside the held-out quarter. A document with
    several labels counts with each."""
    known = labels.select(F.col(id_col).alias("key"), F.col(label_col).alias("label")).filter(
        F.col("key").isNotNull() & F.col("label").isNotNull() & ~held_out("key")
    )
    return stats.join(known, stats[id_col] == known["key"]).select("label", "stats")


def quality(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """``id_col, held_out, score, predicted`` per row of ``docs``.

    A null or empty text is scored like any other, from statistics of nothing. Without two
    labelled rows of each class every score is one half. Repeated rows get equal scores; a
    row with a null id is scored, never trained on. Scores depend on the text alone. Other
    columns are left out. An empty table gives no rows.
    """
    stats = materialise(document_statistics(docs, id_col, text_col), "quality-statistics")
    model = fit(training(stats, labels, id_col, label_col))
    scored = stats.select(F.col(id_col), held_out(id_col).alias("held_out"), scores(model, "stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold; all of them without a model."""
    stats = materialise(document_statistics(docs, id_col, text_col), "quality-statistics")
    model = fit(training(stats, labels, id_col, label_col))
    if model is None:
        return docs
    return docs.filter(text_scores(model, text_col) >= threshold)
