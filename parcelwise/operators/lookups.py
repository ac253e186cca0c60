"""Joins of a large table to a table with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(facts: DataFrame, dimension: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Left join to a table that is unique on ``key``; rows without a key keep nulls.

    Spark chooses the strategy from measured bytes: a small dimension is broadcast, for a larger one both sides are
    shuffled and adaptive execution splits hot keys. Rows without a key match nothing; they would meet in one
    partition, so a second join key deals them out by the hash of ``spread_by``.
    """
    spread = F.when(F.col(key).isNull(), F.xxhash64(spread_by)).otherwise(F.lit(0))
    # Always 0, but not a literal: the optimizer would fold a literal key away.
    only = F.pmod(F.xxhash64(key), F.lit(1))
    return (
        facts.withColumn("_spread", spread.cast("long"))
        .join(dimension.withColumn("_spread", only.cast("long")), [key, "_spread"], "left")
        .drop("_spread")
    )
