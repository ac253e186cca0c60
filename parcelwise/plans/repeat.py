"""Do people come back, and does a late first order change that?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import ratio, share_true


def repeat_summary(first_orders: DataFrame) -> DataFrame:
    """One row over eligible people: repeat rate overall and by lateness of the first order."""
    late, returned = F.col("is_late"), F.col("returned_in_window")
    return first_orders.where("is_eligible").agg(
        F.count(F.lit(1)).alias("eligible_customers"),
        F.count_if(returned).alias("returned"),
        share_true(returned).alias("repeat_rate"),
        share_true(returned, where=late).alias("repeat_if_late"),
        share_true(returned, where=~late).alias("repeat_if_on_time"),
        F.count_if(late).alias("late_first_orders"),
    )


def state_standardised_repeat(first_orders: DataFrame, min_late: int = 20) -> DataFrame:
    """One row: repeat rate after a late first order against the on-time rate in the same mix of states.

    States with few late first orders are left out. ``z`` relates the difference to the binomial error.
    """
    late, returned = F.col("is_late"), F.col("returned_in_window")
    states = (
        first_orders.where("is_eligible")
        .groupBy("customer_state")
        .agg(
            share_true(returned, where=late).alias("late_rate"),
            share_true(returned, where=~late).alias("on_time_rate"),
            F.count_if(late).alias("n_late"),
        )
        .where(F.col("n_late") >= min_late)
    )
    # Rounding the sums hides the order in which states were added.
    weighed = states.agg(
        F.round(ratio(F.sum(F.col("late_rate") * F.col("n_late")), F.sum("n_late")), 9).alias("late"),
        F.round(ratio(F.sum(F.col("on_time_rate") * F.col("n_late")), F.sum("n_late")), 9).alias(
            "on_time_standardised"
        ),
        F.sum("n_late").alias("n_late"),
    )
    p = F.col("on_time_standardised")
    error = F.sqrt(p * (F.lit(1.0) - p) / F.col("n_late"))
    difference = F.col("late") - p
    return weighed.select(
        "late",
        "on_time_standardised",
        "n_late",
        F.round(difference, 9).alias("difference"),
        F.round(F.try_divide(difference, error), 6).alias("z"),
    )
