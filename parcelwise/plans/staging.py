"""Typed tables from the all-text raw tables (column names as in ``sources.raw.RAW_COLUMNS``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


MONEY = "decimal(10,2)"
MOMENT = "timestamp_ntz"


def _typed(name: str, kind: str, alias: str | None = None) -> Column:
    return F.col(name).cast(kind).alias(alias or name)


def _filled(name: str) -> Column:
    """Text without surrounding spaces; blank counts as missing."""
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def stg_orders(raw: DataFrame) -> DataFrame:
    return raw.select(
        "order_id",
        "customer_id",
        "order_status",
        _typed("order_purchase_timestamp", MOMENT, "purchased_at"),
        _typed("order_approved_at", MOMENT, "approved_at"),
        _typed("order_delivered_carrier_date", MOMENT, "shipped_at"),
        _typed("order_delivered_customer_date", MOMENT, "delivered_at"),
        # The text carries a meaningless midnight; the estimate is a date.
        _typed("order_estimated_delivery_date", "date", "estimated_delivery_date"),
    )


def stg_order_items(raw: DataFrame, money: str = MONEY) -> DataFrame:
    return raw.select(
        "order_id",
        _typed("order_item_id", "int"),
        "product_id",
        "seller_id",
        _typed("shipping_limit_date", MOMENT, "shipping_limit_at"),
        _typed("price", money),
        _typed("freight_value", money),
    )


def stg_order_payments(raw: DataFrame, money: str = MONEY) -> DataFrame:
    return raw.select(
        "order_id",
        _typed("payment_sequential", "int"),
        "payment_type",
        _typed("payment_installments", "int"),
        _typed("payment_value", money),
    )


def stg_customers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "customer_id",
        "customer_unique_id",
        F.col("customer_zip_code_prefix").alias("zip_prefix"),
        F.col("customer_city").alias("city"),
        F.upper("customer_state").alias("state"),
    )


def stg_sellers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "seller_id",
        F.col("seller_zip_code_prefix").alias("zip_prefix"),
        F.col("seller_city").alias("city"),
        F.upper("seller_state").alias("state"),
    )


def stg_products(raw: DataFrame, translation: DataFrame) -> DataFrame:
    """Products with the translated category, else the original one, else ``unknown``.

    The translation has a row per category and is broadcast by its size; were it large, adaptive execution would
    split the few categories that cover all products.
    """
    names = translation.select("product_category_name", "product_category_name_english")
    return raw.join(names, "product_category_name", "left").select(
        "product_id",
        F.col("product_category_name").alias("category_pt"),
        F.coalesce("product_category_name_english", "product_category_name", F.lit("unknown")).alias("category"),
        _typed("product_weight_g", "int", "weight_g"),
        _typed("product_photos_qty", "int", "photos_qty"),
    )


def typed_reviews(raw: DataFrame) -> DataFrame:
    """All review rows with types and cleaned text, several per order possible."""
    return raw.select(
        "order_id",
        "review_id",
        _typed("review_score", "int"),
        _filled("review_comment_title").alias("review_title"),
        _filled("review_comment_message").alias("review_message"),
        _typed("review_creation_date", MOMENT, "reviewed_at"),
        _typed("review_answer_timestamp", MOMENT, "review_answered_at"),
    )


def latest_review_per_order(reviews: DataFrame) -> DataFrame:
    """The review answered last; among equals the lowest review_id.

    Spark cuts each map task's rows to one per order before the shuffle (WindowGroupLimit).
    """
    newest_first = Window.partitionBy("order_id").orderBy(
        F.col("review_answered_at").desc_nulls_last(), F.col("review_id").asc_nulls_last()
    )
    return (
        reviews.withColumn("_place", F.row_number().over(newest_first)).where(F.col("_place") == 1).drop("_place")
    )


def stg_order_reviews(raw: DataFrame) -> DataFrame:
    return latest_review_per_order(typed_reviews(raw))
