"""URL filters: rules by host and path, and boosted trees on lexical features for the rest.

All of it is DataFrame functions and Spark's own tree learner.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import materialise

#: Distinct labelled URLs the trees are fitted to, at most; the choice is by hash.
TRAIN_ROWS = 20_000
TREES = 12
DEPTH = 4
SEED = 7
#: URLs no rule decides are blocked where the trees are this sure.
BLOCK_ABOVE = 0.8

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``host/path`` with a verdict: fits the host and its subdomains, and paths that start
    with ``/path``."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host) :]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def host(url: Column) -> Column:
    """Lower-cased from the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host_col: Column, path_col: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, of equals the smaller, as struct of ``rule, verdict``; else
    null. Rules are a list the caller holds, so each is a condition of its own."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.rule), [-ord(c) for c in r.rule])):
        on_host = (host_col == r.host) | host_col.endswith("." + r.host)
        fits = on_host & path_col.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def suffix(host_col: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host_col, ".", -2)


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("double")


def entropy(text: Column) -> Column:
    """Bits a character of a text, from the counts of its distinct characters."""
    n = F.char_length(text).cast("double")

    def bits(c: Column) -> Column:
        # Characters other than this one, taken out, leave its count.
        share = (n - F.char_length(F.call_function("translate", text, c, F.lit("")))) / n
        return share * F.log2(share)

    total = F.aggregate(
        F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: s + F.when(c == "", F.lit(0.0)).otherwise(bits(c))
    )
    return F.when(n > 0, -total).otherwise(F.lit(0.0))


FEATURES = (
    "url_length", "host_length", "path_length", "labels", "depth", "digit_share", "dash_count", "entropy",
    "host_entropy", "parameters", "parameter_length", "fragment", "secure", "numeric_host", "suffix_labels",
    "suffix_depth", "suffix_digits", "suffix_parameters",
)


def lexical(pages: DataFrame) -> DataFrame:
    """``pages`` (``url, host, path``) with lexical features."""
    url = F.coalesce(F.col("url"), F.lit(""))
    asked = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    length = F.char_length(url).cast("double")
    return pages.select(
        "*",
        length.alias("url_length"),
        F.char_length("host").cast("double").alias("host_length"),
        F.char_length("path").cast("double").alias("path_length"),
        count_of(F.col("host"), r"[^.]+").alias("labels"),
        count_of(F.col("path"), r"[^/]+").alias("depth"),
        (count_of(url, "[0-9]") / F.greatest(length, F.lit(1.0))).alias("digit_share"),
        count_of(url, "[-_]").alias("dash_count"),
        entropy(url).alias("entropy"),
        entropy(F.col("host")).alias("host_entropy"),
        count_of(asked, "[^&]+").alias("parameters"),
        F.char_length(asked).cast("double").alias("parameter_length"),
        F.contains(url, F.lit("#")).cast("double").alias("fragment"),
        url.startswith("https:").cast("double").alias("secure"),
        F.col("host").rlike(r"^[0-9.:]+$").cast("double").alias("numeric_host"),
        suffix(F.col("host")).alias("suffix"),
    )


def suffix_statistics(pages: DataFrame) -> DataFrame:
    """Per suffix of all ``pages``: mean labels, depth, digit share and parameters. They are
    rounded, so that trees learn from what a suffix is like and can't use its numbers as its
    name."""
    return pages.groupBy("suffix").agg(
        F.round(F.avg("labels")).alias("suffix_labels"),
        F.round(F.avg("depth")).alias("suffix_depth"),
        F.round(F.avg("digit_share"), 1).alias("suffix_digits"),
        F.round(F.avg("parameters")).alias("suffix_parameters"),
    )


def featured(pages: DataFrame) -> DataFrame:
    """``pages`` (``url, host, path``) with all features.

    Statistics are summed before they are shuffled, written, and joined: Spark broadcasts
    them where their size is within its limit, and splits hot suffixes where it isn't.
    """
    rows = lexical(pages)
    stats = materialise(suffix_statistics(rows.select("suffix", "labels", "depth", "digit_share", "parameters")), "url-suffixes")
    return rows.join(stats, "suffix", "left")


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def first_urls(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows by hash of the URL."""
    return rows.orderBy(F.xxhash64("url"), "url").limit(n)


def training_sample(labelled: DataFrame, train_rows: int) -> DataFrame:
    """``url, label`` and features of at most ``train_rows`` distinct URLs, the first of each
    label by hash: half for each, and what one label leaves goes to the other."""

    def distinct(label: int) -> DataFrame:
        # Copies go before the shuffle, so a much-repeated URL is one row a task. Features
        # follow from the URL, so any copy has them.
        rows = labelled.filter(F.col("label") == label).groupBy("url").agg(*[F.first(f).alias(f) for f in FEATURES])
        return first_urls(rows, train_rows).withColumn("label", F.lit(label).cast("double"))

    rows = materialise(distinct(0).unionByName(distinct(1)), "url-candidates")
    n, blocked = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if n <= train_rows:
        return rows
    of_1 = min(int(blocked), max(train_rows // 2, train_rows - (n - int(blocked))))
    shares = [first_urls(rows.filter(F.col("label") == label), k) for label, k in ((0, train_rows - of_1), (1, of_1))]
    return materialise(shares[0].unionByName(shares[1]), "url-training")


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> GBTClassificationModel | float:
    """Boosted trees from ``url, label`` (0 or 1) and features: on at most ``train_rows``
    distinct URLs, of each label the first by hash. Copies of a URL count once; under both
    labels it counts for each. With one class only, the share of label 1; with no rows, 0."""
    rows = training_sample(labelled, train_rows).select("label", *FEATURES)
    n, good = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or good in (0, n):
        return float(good or 0) / n if n else 0.0
    # Both classes weigh the same, so a score tells what the URL is like, not which is commoner.
    weight = F.when(F.col("label") == 1, F.lit(n / (2 * good))).otherwise(F.lit(n / (2 * (n - good))))
    rows = assembled(rows).select("label", "features", weight.alias("weight"))
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, weightCol="weight", seed=SEED).fit(rows)


def scored(rows: DataFrame, model: GBTClassificationModel | float) -> DataFrame:
    """``rows`` with features, and ``score``: the probability of label 1."""
    if isinstance(model, float):
        return rows.withColumn("score", F.lit(model))
    out = model.transform(assembled(rows))
    return out.withColumn("score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def filter_urls(
    pages: DataFrame,
    rules: list[Rule],
    labelled: DataFrame | None = None,
    threshold: float = BLOCK_ABOVE,
    train_rows: int = TRAIN_ROWS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``id_col, host, path, rule, verdict, score`` per row of ``pages``.

    A rule that fits decides; else trees do, which block where the probability of ``block`` is
    over ``threshold``. They learn from ``labelled`` (``url, label``, 1 for block) or, without
    it, from the URLs that rules decide. A null URL, or one without ``://``, has an empty host
    and path, fits no rule of a host, and is judged by the trees. With nothing to learn from,
    all is allowed. Repeated rows are judged each; other columns are left out.
    An empty table gives no rows.
    """
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = narrow.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = materialise(featured(rows), "url-features")
    if labelled is None:
        taught = rows.filter(F.col("fit").isNotNull()).withColumn("label", (F.col("fit")["verdict"] == "block").cast("int"))
    else:
        named = labelled.select(F.col("url").alias("u"), F.col("label"))
        known = named.select(F.col("u").alias("url"), host(F.col("u")).alias("host"), path(F.col("u")).alias("path"), "label")
        taught = featured(known)
    model = fit(taught, train_rows)
    out = scored(rows, model)
    verdict = F.coalesce(F.col("fit")["verdict"], F.when(F.col("score") > threshold, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(
        F.col("page_id").alias(id_col), "host", "path", F.col("fit")["rule"].alias("rule"), verdict.alias("verdict"), "score"
    )
