"""Registration of this package's queries, beside those of the rest of the library."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lectern.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

#: Rows per Arrow batch: rows hold whole texts.
BATCH_ROWS = "500"

_shipped: set[str] = set()


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        ENTRIES[name] = Entry(run, sql)
        return run

    return add


def prepare(spark: SparkSession) -> None:
    """Session settings the operators expect, and this package on the workers."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        ship_package(spark)
        _shipped.add(application)


def prepared(entry: Entry) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return entry.run(spark, folder)

    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
