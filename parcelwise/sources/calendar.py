"""Generated relations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def day_series(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """One row per day of [start, end)."""
    if end <= start:
        return spark.createDataFrame([], "day date")
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end - dt.timedelta(days=1)))).alias("day")
    )
