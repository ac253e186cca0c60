"""The published route table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: sign between the two states of a route label.
ARROW = " → "


def route_table(
    promise_mart: DataFrame,
    state: str | None = None,
    sort_by: str = "orders",
    ascending: bool = False,
    hot_rate: float = 0.12,
) -> DataFrame:
    """Routes with a label and a hot flag, for one state on either end if given, in a chosen order."""
    chosen = promise_mart
    if state and state.strip():
        wanted = F.lit(state.strip().upper())
        chosen = chosen.where((F.col("seller_state") == wanted) | (F.col("customer_state") == wanted))
    labelled = chosen.select(
        F.concat("seller_state", F.lit(ARROW), "customer_state").alias("route"),
        "orders",
        F.col("median_promised_days").alias("promised"),
        F.col("median_actual_days").alias("actual"),
        F.col("p90_actual_days").alias("p90_actual"),
        "late_rate",
        F.col("bad_review_rate").alias("bad_rate"),
        (F.col("late_rate") >= hot_rate).alias("is_hot"),
    )
    first = F.col(sort_by).asc_nulls_last() if ascending else F.col(sort_by).desc_nulls_last()
    return labelled.orderBy(first, F.col("route").asc_nulls_last())
