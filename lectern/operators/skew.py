"""Joins and string aggregation for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the value columns of ``per_key``, which has one row per key.

    Adaptive execution splits the rows of a hot key, and rows without a key, over tasks. It
    does so only where both sides are shuffled for the join; a side that was grouped by the
    same keys isn't. So the hash of the keys is a join key of its own, by which neither side
    is placed yet.
    """
    values = [c for c in per_key.columns if c not in keys]
    hashed = F.xxhash64(*keys).alias("_hash")
    joined = rows.select("*", hashed).join(per_key.select("*", hashed), ["_hash", *keys], "left")
    return joined.select(*rows.columns, *values)


def concat_ordered(
    df: DataFrame, keys: list[str], order: str, text: str, sep: str, alias: str
) -> DataFrame:
    """Texts of each group joined in the order of an integer column.

    Blocks of ``BLOCK`` consecutive ordinals are joined first, so that a large group is
    spread over many tasks and only its blocks meet in the last step.
    """
    block = F.floor(F.col(order) / BLOCK).alias("_block")

    def join_by(what: str, by: str, name: str) -> Column:
        return F.expr(
            f"listagg(`{what}`, {_literal(sep)}) WITHIN GROUP (ORDER BY `{by}`)"
        ).alias(name)

    blocks = df.groupBy(*keys, block).agg(join_by(text, order, "_text"))
    return blocks.groupBy(*keys).agg(join_by("_text", "_block", alias))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
