"""Published marts over the order fact."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.functions import bad_review, month_start, ratio, share_true
from parcelwise.operators.histograms import weighted_quantile


def _count_true(flag):
    """Number of true flags; null when every flag is null."""
    return F.sum(flag.cast("int"))


def is_delivered():
    """Status delivered and a delivery date: the rule for every delay measure."""
    return (F.col("order_status") == "delivered") & F.col("delivered_at").isNotNull()


def mart_delivery_promise(orders: DataFrame, min_orders: int = 30) -> DataFrame:
    """Promise and reality per route (seller state to customer state), routes with enough orders only."""
    cells = (
        orders.where(is_delivered() & F.col("seller_state").isNotNull())
        .groupBy("seller_state", "customer_state", "promised_days", "actual_days")
        .agg(
            F.count(F.lit(1)).alias("n"),
            _count_true(F.col("is_late")).alias("late"),
            F.count("is_late").alias("timed"),
            _count_true(bad_review()).alias("bad"),
            F.count("review_score").alias("scored"),
            _count_true(F.col("is_late") & bad_review()).alias("bad_late"),
        )
    )
    routes = cells.groupBy("seller_state", "customer_state").agg(
        F.sum("n").alias("orders"),
        weighted_quantile("promised_days", 0.5, "n").alias("median_promised_days"),
        weighted_quantile("actual_days", 0.5, "n").alias("median_actual_days"),
        weighted_quantile("actual_days", 0.9, "n").alias("p90_actual_days"),
        ratio(F.sum("late"), F.sum("timed")).alias("late_rate"),
        ratio(F.sum("bad"), F.sum("scored")).alias("bad_review_rate"),
        F.sum("bad_late").alias("bad_reviews_late"),
    )
    return routes.where(F.col("orders") >= min_orders)


# Columns of the mart.
FIRST_ORDER_COLUMNS = [
    "customer_unique_id",
    "order_id",
    "purchased_at",
    "customer_state",
    "seller_state",
    "is_late",
    "days_late",
    "review_score",
    "items_value",
]


def mart_first_orders(orders: DataFrame, data_end: dt.date, window_days: int = 180) -> DataFrame:
    """First delivered order per person: observed long enough, and followed by another in time?

    ``orders`` needs the order fact without any ranking. Only the first two orders per person matter, and
    Spark drops the others in the map tasks (WindowGroupLimit), so no buyer is too large. Both bounds are
    inclusive and compare times, not dates.
    """
    in_order = Window.partitionBy("customer_unique_id").orderBy(
        F.col("purchased_at").asc_nulls_last(), F.col("order_id").asc_nulls_last()
    )
    window = F.expr(f"interval {int(window_days)} days")
    last_start = F.lit(data_end).cast("timestamp_ntz") - window
    first_two = (
        orders.where(F.col("order_status") == "delivered")
        .select(*[c for c in FIRST_ORDER_COLUMNS if c in orders.columns])
        .withColumn("_place", F.row_number().over(in_order))
        .where(F.col("_place") <= 2)
        .withColumn("next_purchased_at", F.lead("purchased_at").over(in_order))
    )
    return (
        first_two.where(F.col("_place") == 1)
        .drop("_place")
        .withColumn("is_eligible", F.col("purchased_at") <= last_start)
        .withColumn(
            "returned_in_window",
            F.col("next_purchased_at").isNotNull()
            & (F.col("next_purchased_at") <= F.col("purchased_at") + window),
        )
    )


def mart_monthly(orders: DataFrame, timeline: DataFrame, min_orders: int = 400) -> DataFrame:
    """Purchase months. The late rate goes by delivery date whatever the status; the mean score covers all orders.

    New customers are counted from each person's first delivered purchase, which needs no ranking.
    """
    delivered_value = F.when(F.col("order_status") == "delivered", F.col("items_value"))
    months = orders.groupBy(month_start("purchased_at").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("order_status") == "delivered").alias("delivered_orders"),
        F.sum(delivered_value).cast("decimal(24,2)").alias("gmv"),
        ratio(F.sum(delivered_value), F.count(delivered_value)).alias("avg_basket"),
        share_true("is_late", where=F.col("delivered_at").isNotNull()).alias("late_rate"),
        F.avg("review_score").alias("avg_review"),
        (F.count(F.lit(1)) < min_orders).alias("is_partial"),
    )
    starts = (
        timeline.where(F.col("order_status") == "delivered")
        .groupBy("customer_unique_id")
        .agg(F.min("purchased_at").alias("first_at"))
        .groupBy(month_start("first_at").alias("start_month"))
        .agg(F.count(F.lit(1)).alias("started"))
    )
    return months.join(starts, months["month"].eqNullSafe(starts["start_month"]), "left").select(
        "month",
        "orders",
        "delivered_orders",
        "gmv",
        "avg_basket",
        "late_rate",
        "avg_review",
        F.coalesce("started", F.lit(0)).cast("long").alias("new_customers"),
        "is_partial",
    )


def mart_seller_delivery(items: DataFrame, orders: DataFrame, sellers: DataFrame) -> DataFrame:
    """Delay and reviews per seller, at the grain order x seller: a two-seller order counts for both.

    The seller's state joins after the aggregation, one row per seller, so a dominant seller is no hot key.
    """
    pairs = items.select("order_id", "seller_id").distinct()
    measures = orders.where(is_delivered()).select("order_id", "is_late", "review_score")
    per_seller = (
        pairs.join(measures, "order_id")
        .groupBy("seller_id")
        .agg(
            F.count(F.lit(1)).alias("delivered_orders"),
            _count_true(F.col("is_late")).alias("late_orders"),
            share_true("is_late").alias("late_rate"),
            F.avg("review_score").alias("avg_review"),
            _count_true(bad_review()).alias("bad_reviews"),
        )
    )
    states = sellers.select("seller_id", F.col("state").alias("seller_state"))
    return per_seller.join(states, "seller_id").select(
        "seller_id", "seller_state", "delivered_orders", "late_orders", "late_rate", "avg_review", "bad_reviews"
    )
