"""A promise that follows recent deliveries: delay quantile of the deliveries of the last days."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.functions import day, ratio
from parcelwise.operators.histograms import weighted_quantile, whole_days


def delivery_cells(delivered: DataFrame) -> DataFrame:
    """Delivered orders counted per purchase date, delivery date and customer state.

    Both the recent deliveries and the orders to promise for come from these counts, so the orders are read
    once. Without a ``seller_state`` column no order counts as a single-seller one.
    """
    one_seller = F.col("seller_state").isNotNull() if "seller_state" in delivered.columns else F.lit(False)
    return delivered.groupBy(
        day("purchased_at").alias("purchased_on"),
        day("delivered_at").alias("delivered_on"),
        "customer_state",
        "actual_days",
        one_seller.alias("is_single_seller"),
    ).agg(F.count(F.lit(1)).alias("n_orders"))


def rolling_quantile(
    cells: DataFrame,
    start: dt.date,
    end: dt.date,
    by: Sequence[str] = ("customer_state",),
    window_days: int = 14,
    p: float = 0.93,
) -> DataFrame:
    """Per day of [start, end) and group: quantile and number of the deliveries in [day - window, day).

    Counts per delivery day stand once in order of the days, together with one row for every day that is asked for; a
    frame over the range of days before it gives the quantile. No count is copied to the days it serves.
    """
    daily = (
        cells.where(
            (F.col("delivered_on") < F.lit(end)) & (F.col("delivered_on") >= F.date_sub(F.lit(start), window_days))
        )
        .groupBy("delivered_on", *by, "actual_days")
        .agg(F.sum("n_orders").alias("n_orders"))
        # Always so; with it, both readers need the counts and share one aggregation.
        .where(F.col("n_orders") > 0)
    )
    first = F.greatest(F.lit(start), F.date_add(F.min("delivered_on"), 1))
    last = F.least(F.lit(end - dt.timedelta(days=1)), F.date_add(F.max("delivered_on"), window_days))
    asked = (
        daily.groupBy(*by)
        .agg(first.alias("_first"), last.alias("_last"))
        .where(F.col("_first") <= F.col("_last"))
        .select(*by, F.explode(F.sequence("_first", "_last")).alias("day"))
    )
    in_order = daily.withColumnRenamed("delivered_on", "day").unionByName(asked, allowMissingColumns=True)
    frame = Window.partitionBy(*by).orderBy(F.unix_date("day")).rangeBetween(-window_days, -1)
    return (
        in_order.select(
            "day",
            *by,
            "actual_days",
            weighted_quantile("actual_days", p, "n_orders", frame).alias("q"),
            F.sum("n_orders").over(frame).alias("n"),
        )
        .where(F.col("actual_days").isNull() & (F.col("n") > 0))
        .drop("actual_days")
    )


def evaluate_rolling_policy(
    cells: DataFrame,
    by_day: DataFrame,
    by_day_and_state: DataFrame,
    cutoff: dt.date,
    min_deliveries: int = 50,
    focus_month: int = 3,
) -> DataFrame:
    """One row: mean promise and late rates of the rolling rule over single-seller orders from the cutoff on.

    Orders bought on a day without any delivery in the window have no promise and are left out of the means;
    ``orders_without_window`` counts them.
    """
    bought = (
        cells.where((F.col("purchased_on") >= F.lit(cutoff)) & F.col("is_single_seller"))
        .groupBy(F.col("purchased_on").alias("day"), "customer_state", "actual_days")
        .agg(F.sum("n_orders").alias("n_orders"))
    )
    # One row per calendar day between two parameters.
    whole = F.broadcast(by_day.select("day", F.col("q").alias("_all_q")))
    states = by_day_and_state.select("day", "customer_state", F.col("q").alias("_state_q"), F.col("n").alias("_state_n"))
    promised = (
        bought.join(whole, "day", "left")
        .join(states, ["day", "customer_state"], "left")
        .withColumn("_covered", F.col("_all_q").isNotNull())
        .withColumn(
            "_promise",
            whole_days(F.when(F.col("_state_n") >= min_deliveries, F.col("_state_q")).otherwise(F.col("_all_q"))),
        )
        .withColumn("_late", F.col("actual_days") > F.col("_promise"))
    )

    def covered(value):
        return F.sum(F.when(F.col("_covered"), value))

    in_focus = F.when(F.month("day") == focus_month, F.col("n_orders"))
    late = F.col("_late").cast("int")
    return promised.agg(
        F.coalesce(covered(F.col("n_orders")), F.lit(0)).alias("orders"),
        F.coalesce(F.sum(F.when(~F.col("_covered"), F.col("n_orders"))), F.lit(0)).alias("orders_without_window"),
        ratio(covered(F.col("n_orders") * F.col("_promise")), covered(F.col("n_orders"))).alias("new_promise"),
        ratio(covered(F.col("n_orders") * late), covered(F.col("n_orders"))).alias("new_late_rate"),
        ratio(covered(in_focus * late), covered(in_focus)).alias("focus_late_rate"),
    )
