"""The registered queries: each a Spark query and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None
    needs_workers: bool


ENTRIES: dict[str, Entry] = {}
_shipped: set[str] = set()


def query(name: str, sql: str | None = None, workers: bool = False) -> Callable[[Query], Query]:
    """Register a query; ``workers`` marks those that run Python on the executors."""

    def add(run: Query) -> Query:
        ENTRIES[name] = Entry(run, sql, workers)
        return run

    return add


def prepared(entry: Entry) -> Query:
    """The query with UTC times, scalar columns of the oracle's types, and, if it needs it,
    the package on the workers."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        application = spark.sparkContext.applicationId
        if entry.needs_workers and application not in _shipped:
            ship_package(spark, "checks")
            _shipped.add(application)
        return plain_types(entry.run(spark, folder))

    return run


def plain_types(df: DataFrame) -> DataFrame:
    wide = {T.IntegerType(): "bigint", T.ShortType(): "bigint", T.FloatType(): "double"}
    return df.select(
        *[
            F.col(f.name).cast(wide[f.dataType]).alias(f.name) if f.dataType in wide else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def flat_messages(messages: Column | str = "messages") -> Column:
    """Messages as one text, for comparing."""
    return F.array_join(
        F.transform(
            messages,
            lambda m: F.concat_ws(
                "=", F.coalesce(m["role"], F.lit("?")), F.coalesce(m["content"], F.lit("?"))
            ),
        ),
        "|",
    )
