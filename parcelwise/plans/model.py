"""The star schema: order facts, line facts and dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.functions import day, days_between
from parcelwise.operators.lookups import lookup
from parcelwise.operators.slices import ranked_sequence

TOTAL = "decimal(20,2)"


def _in_cents(df: DataFrame, amount: str) -> bool:
    kind = df.schema[amount].dataType
    return isinstance(kind, T.DecimalType) and kind.scale == 2 and kind.precision <= 16


def _summed(df: DataFrame, amount: str) -> Column:
    """Sum of an amount, as whole cents where these are exact."""
    return F.sum((F.col(amount) * 100).cast("long") if _in_cents(df, amount) else F.col(amount))


def _as_total(df: DataFrame, amount: str, total: Column) -> Column:
    """A sum of ``_summed`` ones as an amount."""
    return (total * F.lit("0.01").cast("decimal(3,2)") if _in_cents(df, amount) else total).cast(TOTAL)


def amount_total(df: DataFrame, amount: str) -> Column:
    """Exact sum of an amount per group.

    Amounts of two decimals and up to 16 digits are added up as whole cents in a long; a decimal sum would
    exceed 18 digits and go through big-number objects for every row.
    """
    return _as_total(df, amount, _summed(df, amount))


def order_item_rollup(items: DataFrame) -> DataFrame:
    """Lines and amounts per order, with the number of its sellers.

    Lines are added up per order and seller first: a distinct count would do the same with the seller in each row twice.
    """
    per_seller = items.groupBy("order_id", "seller_id").agg(
        F.count(F.lit(1)).alias("_lines"), _summed(items, "price").alias("_price"), _summed(items, "freight_value").alias("_freight")
    )
    return per_seller.groupBy("order_id").agg(
        F.sum("_lines").alias("items_count"),
        F.count("seller_id").alias("sellers_count"),
        F.min("seller_id").alias("any_seller_id"),
        _as_total(items, "price", F.sum("_price")).alias("items_value"),
        _as_total(items, "freight_value", F.sum("_freight")).alias("freight_value"),
    )


def order_payment_rollup(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(
        amount_total(payments, "payment_value").alias("payment_value"),
        F.max("payment_installments").alias("installments"),
    )


def single_seller_rollup(items: DataFrame) -> DataFrame:
    """Per order: amounts, and the seller if there is just one.

    Lowest and highest seller tell that without counting distinct ones, which would cost a second shuffle of
    the lines.
    """
    totals = items.groupBy("order_id").agg(
        F.min("seller_id").alias("_first"),
        F.max("seller_id").alias("_last"),
        amount_total(items, "price").alias("items_value"),
        amount_total(items, "freight_value").alias("freight_value"),
    )
    return totals.select(
        "order_id",
        F.when(F.col("_first") == F.col("_last"), F.col("_first")).alias("seller_id"),
        "items_value",
        "freight_value",
    )


def order_timeline(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with their buyer and the promise measured in calendar days.

    Lateness is null while an order is undelivered. Everything that needs neither items, payments nor reviews
    starts here rather than from the full fact.
    """
    buyers = customers.select("customer_id", "customer_unique_id", F.col("state").alias("customer_state"))
    return orders.join(buyers, "customer_id").select(
        "order_id",
        "customer_unique_id",
        "customer_state",
        "order_status",
        "purchased_at",
        "shipped_at",
        "delivered_at",
        "estimated_delivery_date",
        days_between("purchased_at", "estimated_delivery_date").alias("promised_days"),
        days_between("purchased_at", "delivered_at").alias("actual_days"),
        days_between("estimated_delivery_date", "delivered_at").alias("days_late"),
        (day("delivered_at") > F.col("estimated_delivery_date")).alias("is_late"),
    )


def with_items(timeline: DataFrame, items: DataFrame) -> DataFrame:
    """Add item totals; the seller is set only where the order has exactly one."""
    joined = timeline.join(order_item_rollup(items), "order_id", "left")
    return joined.withColumn("seller_id", F.when(F.col("sellers_count") == 1, F.col("any_seller_id"))).drop(
        "any_seller_id"
    )


def with_single_seller(timeline: DataFrame, items: DataFrame) -> DataFrame:
    """Add amounts and the only seller; cheaper than ``with_items`` where the counts are not needed."""
    return timeline.join(single_seller_rollup(items), "order_id", "left")


def with_payments(timeline: DataFrame, payments: DataFrame) -> DataFrame:
    return timeline.join(order_payment_rollup(payments), "order_id", "left")


def with_reviews(timeline: DataFrame, reviews: DataFrame) -> DataFrame:
    """Add the review of each order; ``reviews`` holds at most one row per order."""
    kept = reviews.select("order_id", "review_score", "reviewed_at", "review_message")
    return timeline.join(kept, "order_id", "left").select(
        *timeline.columns,
        "review_score",
        "reviewed_at",
        F.col("review_message").isNotNull().alias("has_review_text"),
        (day("reviewed_at") < day("delivered_at")).alias("reviewed_before_delivery"),
    )


def with_seller_state(orders: DataFrame, sellers: DataFrame) -> DataFrame:
    states = sellers.select("seller_id", F.col("state").alias("seller_state"))
    return lookup(orders, states, "seller_id", spread_by="order_id")


# The columns of the order fact.
ENRICHED_COLUMNS = [
    "order_id",
    "customer_unique_id",
    "customer_state",
    "order_status",
    "purchased_at",
    "delivered_at",
    "estimated_delivery_date",
    "items_count",
    "sellers_count",
    "seller_id",
    "items_value",
    "freight_value",
    "payment_value",
    "installments",
    "review_score",
    "reviewed_at",
    "has_review_text",
    "promised_days",
    "actual_days",
    "days_late",
    "is_late",
    "reviewed_before_delivery",
]


def enriched_orders(timeline: DataFrame, items: DataFrame, payments: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per order with amounts, the review that counts and the promise measures.

    All three right sides hold one row per order, so nothing fans out and the joins share one key.
    """
    joined = with_reviews(with_payments(with_items(timeline, items), payments), reviews)
    return joined.select(*ENRICHED_COLUMNS)


def customer_order_sequence(timeline: DataFrame, slices: int | None = None) -> DataFrame:
    """Place of each order of status ``delivered`` in its buyer's history, and the next purchase.

    Writes the delivered orders once, range-partitioned by buyer and time.
    """
    bought = timeline.where(F.col("order_status") == "delivered").select(
        "order_id", "customer_unique_id", "purchased_at"
    )
    return ranked_sequence(
        bought,
        key="customer_unique_id",
        order=["purchased_at", "order_id"],
        rank="order_rank",
        following="next_purchased_at",
        slices=slices,
    )


def _with_rank(orders: DataFrame, sequence: DataFrame) -> DataFrame:
    return orders.join(sequence.select("order_id", "order_rank"), "order_id", "left")


def fct_orders(enriched: DataFrame, sellers: DataFrame, sequence: DataFrame) -> DataFrame:
    return _fact(with_seller_state(_with_rank(enriched, sequence), sellers), enriched.columns)


def ranked_fact(orders: DataFrame, columns: Sequence[str], sequence: DataFrame) -> DataFrame:
    """The order fact from orders that have ``columns`` and the state of their seller."""
    return _fact(_with_rank(orders, sequence), columns)


def _fact(ranked: DataFrame, columns: Sequence[str]) -> DataFrame:
    return ranked.select(*columns, "seller_state", "order_rank", (F.col("order_rank") == 1).alias("is_first_order"))


def fct_order_items(items: DataFrame) -> DataFrame:
    return items.select(
        "order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_at", "price", "freight_value"
    )


def dim_sellers(sellers: DataFrame) -> DataFrame:
    return sellers.select("seller_id", "state", "city", "zip_prefix")


def dim_products(products: DataFrame) -> DataFrame:
    return products.select("product_id", "category", "category_pt", "weight_g", "photos_qty")


def dim_customers(customers: DataFrame, timeline: DataFrame) -> DataFrame:
    """One row per person.

    ``delivered_orders`` counts orders once each. Joining every customer_id of a person to every order of that
    person would count each order as often as the person has ids.
    """
    people = customers.groupBy("customer_unique_id").agg(F.min("state").alias("state"), F.min("city").alias("city"))
    bought = (
        timeline.where(F.col("order_status") == "delivered")
        .groupBy("customer_unique_id")
        .agg(F.min("purchased_at").alias("first_purchased_at"), F.count("order_id").alias("_orders"))
    )
    return people.join(bought, "customer_unique_id", "left").select(
        "customer_unique_id",
        "state",
        "city",
        "first_purchased_at",
        F.coalesce("_orders", F.lit(0)).cast("long").alias("delivered_orders"),
    )
