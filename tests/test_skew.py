"""Groups that hold a third of all rows, and the ways around them."""

from collections import Counter

from pyspark.sql import functions as F

from lectern.operators import skew
from lectern.operators.decks import attach_images, dedup_images, image_blobs


def hot(spark, n=3000):
    """A third of the rows have one key, the others three rows per key."""
    return spark.range(n).select(
        "id", F.when(F.col("id") < n // 3, "hot").otherwise((F.col("id") % (n // 3)).cast("string")).alias("k")
    )


def per_key(df):
    return df.groupBy("k").agg(F.min("id").alias("first"))


def test_join_per_key_equals_the_plain_join(spark):
    rows = hot(spark)
    got = skew.join_per_key(rows, per_key(rows), ["k"])
    want = rows.join(per_key(rows), "k").select("id", "k", "first")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


def padded(rows):
    """Rows that don't shrink when they are compressed, in some tasks."""
    return rows.withColumn("pad", F.sha2(F.col("id").cast("string"), 512)).repartition(16, "id")


def largest_task(spark, rows):
    """Rows in the largest task of the join, and its plan, with thresholds to match the rows."""
    for name, value in SPLIT.items():
        spark.conf.set(name, value)
    try:
        joined = skew.join_per_key(rows, per_key(rows), ["k"])
        placed = joined.select(F.spark_partition_id().alias("p"), "first", "pad")
        sizes = Counter(r["p"] for r in placed.collect())
        return max(sizes.values()), placed._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in SPLIT:
            spark.conf.unset(name)


def test_hot_rows_are_spread(spark):
    rows = padded(hot(spark, 30_000))
    most, plan = largest_task(spark, rows)
    assert most < 30_000 / 4 and "skew=true" in plan and "Broadcast" not in plan


def test_null_keys_stay(spark):
    rows = spark.createDataFrame([(1, None), (2, "a")], "id long, k string")
    got = skew.join_per_key(rows, per_key(rows), ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, None, None), (2, "a", 2)]


def test_rows_without_a_key_are_spread(spark):
    rows = padded(hot(spark, 30_000).withColumn("k", F.when(F.col("k") != "hot", F.col("k"))))
    most, plan = largest_task(spark, rows)
    assert most < 30_000 / 4 and "skew=true" in plan


def test_much_copied_image(spark):
    rows = hot(spark).select(
        F.lit("d").alias("deck"),
        (F.col("id") + 1).cast("int").alias("slide_number"),
        F.lit(0).alias("ordinal"),
        F.lit("png").alias("image_format"),
        F.col("k").alias("sha1"),
    )
    paths = Counter(r["image_path"] for r in dedup_images(rows).collect())
    assert paths["slide001_hot.png"] == 1000 and sum(paths.values()) == 3000
    assert len(paths) == 1001


def test_slide_with_a_third_of_the_images(spark):
    number = F.when(F.col("k") == "hot", 1).otherwise(F.col("k").cast("int") + 2)
    images = hot(spark).select(
        F.lit("d").alias("deck"),
        number.cast("int").alias("slide_number"),
        F.col("id").cast("int").alias("ordinal"),
    )
    slides = spark.range(1, 1500).select(
        F.lit("d").alias("deck"), F.col("id").cast("int").alias("slide_number"), F.concat(F.lit("t"), "id").alias("text")
    )
    got = attach_images(slides, images).select("slide_number", "text", "image.ordinal")
    want = slides.join(images, ["deck", "slide_number"], "left").select("slide_number", "text", "ordinal")
    stray = images.withColumn("deck", F.when(F.col("slide_number") == 1, "no such deck").otherwise("d"))
    assert attach_images(slides, stray).filter("image IS NOT NULL").count() == want.filter("slide_number > 1 AND ordinal IS NOT NULL").count()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_concat_ordered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(skew, "BLOCK", 7)
    rows = hot(spark, 300).withColumn("text", F.concat(F.lit("it's "), F.col("id").cast("string")))
    got = {r["k"]: r["t"] for r in skew.concat_ordered(rows, ["k"], "id", "text", "\n", "t").collect()}
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r["id"]):
        want.setdefault(r["k"], []).append(r["text"])
    assert got == {k: "\n".join(v) for k, v in want.items()}


def test_each_input_is_read_few_times(spark, tmp_path):
    images = hot(spark, 300).select(
        F.lit("d").alias("deck"), F.col("id").cast("int").alias("slide_number"), F.lit(0).alias("ordinal"),
        F.lit("png").alias("image_format"), F.col("k").alias("sha1"), F.encode("k", "UTF-8").alias("blob"),
    )
    images.write.parquet(str(tmp_path / "images"))
    stored = spark.read.parquet(str(tmp_path / "images"))
    slides = stored.select("deck", "slide_number", F.lit("t").alias("text"))

    def scans(df):
        return df._jdf.queryExecution().sparkPlan().toString().count("FileScan")

    assert scans(dedup_images(stored)) == 2
    assert scans(image_blobs(stored)) == 2
    assert scans(attach_images(slides, stored.drop("blob"))) == 4
