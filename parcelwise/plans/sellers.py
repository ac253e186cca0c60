"""Who causes the delay: seller or carrier, and which sellers are late beyond what their routes explain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import days_between, mean_of, ratio, share_true
from parcelwise.operators.slices import running_totals
from parcelwise.plans.marts import is_delivered
from parcelwise.session import materialised


def handover(timeline: DataFrame, items: DataFrame) -> DataFrame:
    """Delivered orders split into the seller's and the carrier's days.

    Orders with impossible dates are left out. The seller is late when the parcel leaves after the last
    shipping limit among the order's lines.
    """
    limits = items.groupBy("order_id").agg(F.max("shipping_limit_at").alias("limit_at"))
    possible = timeline.where(
        is_delivered()
        & (F.col("shipped_at") >= F.col("purchased_at"))
        & (F.col("delivered_at") >= F.col("shipped_at"))
    )
    return possible.join(limits, "order_id").select(
        "order_id",
        "is_late",
        (F.col("shipped_at") > F.col("limit_at")).alias("seller_late"),
        days_between("purchased_at", "shipped_at").alias("seller_days"),
        days_between("shipped_at", "delivered_at").alias("carrier_days"),
    )


def handover_summary(handovers: DataFrame) -> DataFrame:
    late, seller_late = F.col("is_late"), F.col("seller_late")
    return handovers.agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(seller_late).alias("seller_late_orders"),
        share_true(late, where=seller_late).alias("late_rate_if_seller_late"),
        share_true(late, where=~seller_late).alias("late_rate_if_seller_on_time"),
        F.count_if(late).alias("late_orders"),
        F.count_if(late & ~seller_late).alias("late_with_seller_on_time"),
        mean_of("seller_days", where=late).alias("seller_days_late"),
        mean_of("carrier_days", where=late).alias("carrier_days_late"),
        mean_of("seller_days", where=~late).alias("seller_days_on_time"),
        mean_of("carrier_days", where=~late).alias("carrier_days_on_time"),
    )


def _delivered_pairs(items: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per delivered order and seller in it, so an order counts once for each of its sellers."""
    kept = [c for c in ("order_id", "customer_state", "is_late", "review_score") if c in orders.columns]
    return items.select("order_id", "seller_id").distinct().join(orders.where(is_delivered()).select(*kept), "order_id")


def order_sellers(items: DataFrame, orders: DataFrame, sellers: DataFrame) -> DataFrame:
    """Delivered order x seller with both states, lateness and score."""
    states = sellers.select("seller_id", F.col("state").alias("seller_state"))
    return _delivered_pairs(items, orders).join(states, "seller_id").select(
        "order_id", "seller_id", "seller_state", "customer_state", "is_late", "review_score"
    )


def seller_excess(items: DataFrame, orders: DataFrame, sellers: DataFrame) -> DataFrame:
    """Per seller: orders, late orders, and late orders expected from the late rate of each route served.

    Order-seller pairs are first counted per (seller, customer state). The state and route joins then handle
    those counts, and neither a dominant seller nor a dominant route is a hot key. The counts are read twice,
    for the routes and for the sellers, and therefore written once.
    """
    cells = (
        _delivered_pairs(items, orders)
        .groupBy("seller_id", "customer_state")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("is_late").alias("timed"),
            F.sum(F.col("is_late").cast("int")).alias("late"),
        )
    )
    states = sellers.select("seller_id", F.col("state").alias("seller_state"))
    placed = materialised(cells.join(states, "seller_id"))
    routes = placed.groupBy("seller_state", "customer_state").agg(
        ratio(F.sum("late"), F.sum("timed")).alias("route_rate")
    )
    return (
        placed.join(routes, ["seller_state", "customer_state"])
        .groupBy("seller_id")
        .agg(
            F.sum("n").alias("orders"),
            F.sum("late").alias("late"),
            F.sum(F.col("n") * F.col("route_rate")).alias("expected"),
        )
    )


def flag_excess_sellers(
    excess: DataFrame, min_orders: int = 30, times_expected: float = 1.5, min_excess: float = 5
) -> DataFrame:
    """Sellers with enough orders and clearly more late orders than their routes explain."""
    return excess.where(
        (F.col("orders") >= min_orders)
        & (F.col("late") > times_expected * F.col("expected"))
        & (F.col("late") - F.col("expected") >= min_excess)
    ).withColumn("excess", F.col("late") - F.col("expected"))


def excess_summary(flagged: DataFrame) -> DataFrame:
    """One row: flagged sellers and their summed excess in whole orders (null when none is flagged)."""
    return flagged.agg(
        F.count(F.lit(1)).alias("excess_sellers"), F.round(F.sum("excess")).alias("excess_late")
    )


def seller_concentration(excess: DataFrame, share: float = 0.5, slices: int | None = None) -> DataFrame:
    """Fewest sellers that together hold ``share`` of the late orders, and their share of all orders.

    The running totals go by range slices, as many as there are shuffle partitions unless given.
    """
    ordered = running_totals(
        excess.select("seller_id", "orders", "late"),
        order=[F.col("late").desc_nulls_last(), F.col("seller_id").asc_nulls_last()],
        totals={"cum_late": "late", "cum_orders": "orders"},
        rank="rank",
        slices=slices,
    )
    reached = F.col("cum_late") >= share * F.col("cum_late_all")
    return ordered.agg(
        F.count(F.lit(1)).alias("sellers"),
        F.max("cum_late_all").alias("late_orders"),
        F.min(F.when(reached, F.col("rank"))).alias("sellers_for_share"),
        ratio(F.min(F.when(reached, F.col("cum_orders"))), F.max("cum_orders_all")).alias("order_share"),
    )
