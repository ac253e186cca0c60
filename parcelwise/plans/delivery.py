"""How promised and real delivery relate, over time and by review."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import (
    bad_review,
    day,
    delay_bucket,
    delay_bucket_rank,
    late_peak,
    mean_of,
    share_true,
)
from parcelwise.functions.columns import DELAY_EDGES
from parcelwise.plans.marts import is_delivered


def with_delay_bucket(orders: DataFrame, edges: Sequence[int] = DELAY_EDGES) -> DataFrame:
    """Delivered orders with their delay class."""
    return orders.where(is_delivered()).withColumn("bucket", delay_bucket("actual_days", edges))


def scope_summary(orders: DataFrame) -> DataFrame:
    """One row: how many orders, how many of them usable. ``orders`` needs the review columns; one scan."""
    delivered = is_delivered()
    return orders.agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(delivered).alias("delivered"),
        day(F.min(F.when(delivered, F.col("purchased_at")))).alias("first_purchase"),
        day(F.max(F.when(delivered, F.col("purchased_at")))).alias("last_purchase"),
        F.count_if(delivered & F.col("review_score").isNotNull()).alias("reviewed"),
        F.count_if(delivered & F.col("has_review_text")).alias("reviewed_with_text"),
    )


def monthly_promise(delivered: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Mean promise, mean delay, late rate and mean score per purchase month of [start, end)."""
    in_range = delivered.where(
        (F.col("purchased_at") >= F.lit(start).cast("timestamp_ntz"))
        & (F.col("purchased_at") < F.lit(end).cast("timestamp_ntz"))
    )
    return (
        in_range.groupBy(F.date_format(F.trunc(day("purchased_at"), "month"), "yyyy-MM").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.avg("promised_days").alias("promised_days"),
            F.avg("actual_days").alias("actual_days"),
            share_true("is_late").alias("late_rate"),
            F.avg("review_score").alias("avg_review"),
        )
        .orderBy("month")
    )


def late_peaks(monthly: DataFrame, at_least: float = 0.12) -> DataFrame:
    """Months with a high late rate that the next month does not exceed. One row per month goes in."""
    return monthly.withColumn("_peak", late_peak("late_rate", "month", at_least)).where("_peak").drop("_peak")


def delay_vs_promise(delivered: DataFrame, edges: Sequence[int] = DELAY_EDGES) -> DataFrame:
    """Bad-review rate by delay class and kept or broken promise: at equal delay, does lateness matter?"""
    return (
        delivered.where(F.col("review_score").isNotNull())
        .groupBy("bucket", "is_late", delay_bucket_rank("actual_days", edges).alias("_rank"))
        .agg(F.count(F.lit(1)).alias("orders"), share_true(bad_review()).alias("bad_rate"))
        .orderBy("_rank", F.col("is_late").asc_nulls_last())
        .drop("_rank")
    )


def bad_review_timing(delivered: DataFrame) -> DataFrame:
    """One row: bad reviews among late orders, and reviews written before the parcel arrived."""
    early = F.col("reviewed_before_delivery")
    return delivered.where(F.col("review_score").isNotNull()).agg(
        F.count_if(bad_review()).alias("bad"),
        F.count_if(bad_review() & F.col("is_late")).alias("bad_late"),
        F.count_if(bad_review() & early).alias("bad_before_delivery"),
        F.count_if(early).alias("reviewed_before_delivery"),
        share_true("is_late", where=early).alias("late_rate_before_delivery"),
        mean_of("review_score", where=early).alias("avg_score_before_delivery"),
        mean_of("review_score", where=~early).alias("avg_score_after_delivery"),
    )
