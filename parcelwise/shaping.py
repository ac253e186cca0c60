"""The driver's order and line tables in the shape of the fulfilment model.

Deterministic expressions only: delivery follows the distance between order date and ship dates, the promise
follows the order priority, reviews follow the lines. Amounts become decimals before any arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions import days_between
from parcelwise.plans.model import amount_total
from parcelwise.session import new_place
from parcelwise.sources.tables import forget_bucketed, save_bucketed

AMOUNT = "decimal(12,2)"


class DriverTables:
    """The driver's tables in one folder; each is opened once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._open: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._open[name]


# The keys that orders and lines meet on, and the columns that any relation here takes from them.
ORDER_KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
ORDER_COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_shipdate"
    ],
}


class DealtTables(DriverTables):
    """The driver's tables with orders and lines in equal buckets of orders, written under ``place`` when first asked for.

    What is grouped, ranked or joined by order from them needs no exchange, however often it is asked for.
    """

    def __init__(self, source: DriverTables, place: str):
        super().__init__(source.spark, source.folder)
        self.place, self.names = place, []

    def __getitem__(self, name: str) -> DataFrame:
        if name in ORDER_KEYS and name not in self._open:
            table = super().__getitem__(name).select(*ORDER_COLUMNS[name])
            self._open[name] = self.saved(name, table, ORDER_KEYS[name])
        return super().__getitem__(name)

    def saved(self, name: str, table: DataFrame, key: str) -> DataFrame:
        """``table`` in buckets like those of the orders."""
        self.names.append(name)
        return save_bucketed({name: table}, self.place, key)[name]


@contextmanager
def dealt(source: DriverTables) -> Iterator[DealtTables]:
    """Dealt tables that the catalog forgets at the end; their files go with the innermost open scope."""
    opened = DealtTables(source, new_place(source.spark, "dealt"))
    try:
        yield opened
    finally:
        forget_bucketed(source.spark, opened.place, opened.names)


def _plus_days(moment: str, days: Column) -> Column:
    return F.timestamp_add("DAY", days.cast("int"), F.col(moment))


def _places(source: DriverTables) -> DataFrame:
    """Nation key, nation name and region name."""
    nation, region = source["nation"], source["region"]
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("_nation"), F.col("n_name").alias("city"), F.upper("r_name").alias("state")
    )


def orders(source: DriverTables) -> DataFrame:
    spans = (
        source["lineitem"]
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.min("l_shipdate").alias("_first_ship"), F.max("l_shipdate").alias("_last_ship"))
    )
    shipped_only = F.col("o_orderstatus") == "O"
    wait = F.abs(days_between("o_orderdate", "_last_ship")) % 45
    preparation = F.abs(days_between("o_orderdate", "_first_ship")) % 20
    patience = 10 + 5 * F.substring("o_orderpriority", 1, 1).cast("int")
    return (
        source["orders"]
        .join(spans, "o_orderkey", "left")
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderkey").alias("customer_id"),
            F.when(shipped_only, "shipped").otherwise("delivered").alias("order_status"),
            F.col("o_orderdate").alias("purchased_at"),
            F.col("o_orderdate").alias("approved_at"),
            _plus_days("o_orderdate", preparation).alias("shipped_at"),
            F.when(~F.coalesce(shipped_only, F.lit(False)), _plus_days("o_orderdate", wait)).alias("delivered_at"),
            F.date_add(F.col("o_orderdate").cast("date"), patience).alias("estimated_delivery_date"),
        )
    )


def customers(source: DriverTables) -> DataFrame:
    """One customer_id per order, as in the source; the person is the customer key."""
    return (
        source["orders"]
        .join(source["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(_places(source), F.col("c_nationkey") == F.col("_nation"))
        .select(
            F.col("o_orderkey").alias("customer_id"),
            F.col("o_custkey").alias("customer_unique_id"),
            F.col("c_nationkey").cast("string").alias("zip_prefix"),
            "city",
            "state",
        )
    )


def sellers(source: DriverTables) -> DataFrame:
    return (
        source["supplier"]
        .join(_places(source), F.col("s_nationkey") == F.col("_nation"))
        .select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("s_nationkey").cast("string").alias("zip_prefix"),
            "city",
            "state",
        )
    )


def raw_products(source: DriverTables) -> DataFrame:
    """One category is blanked to exercise the fallback."""
    return source["part"].select(
        F.col("p_partkey").alias("product_id"),
        F.nullif(F.col("p_type"), F.lit("ECONOMY")).alias("product_category_name"),
        F.col("p_size").cast("string").alias("product_weight_g"),
        (F.col("p_size") % 5).cast("string").alias("product_photos_qty"),
    )


def category_translation(source: DriverTables) -> DataFrame:
    """Lower-case names for all categories but one, which stays untranslated."""
    return (
        source["part"]
        .where(F.col("p_type") != "PROMO")
        .select(F.col("p_type").alias("product_category_name"), F.lower("p_type").alias("product_category_name_english"))
        .distinct()
    )


def _items(lines: DataFrame, *more: Column) -> DataFrame:
    price = F.col("l_extendedprice").cast(AMOUNT)
    return lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        *more,
        price.alias("price"),
        (price * F.col("l_tax").cast("decimal(4,2)")).cast(AMOUNT).alias("freight_value"),
    )


def items(source: DriverTables) -> DataFrame:
    """Order lines without the shipping limit, which alone would need the orders."""
    return _items(source["lineitem"])


def items_with_limit(source: DriverTables) -> DataFrame:
    dates = source["orders"].select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lines = source["lineitem"].join(dates, "l_orderkey", "left")
    return _items(lines, _plus_days("o_orderdate", 3 + F.col("l_linenumber")).alias("shipping_limit_at"))


def payments(source: DriverTables) -> DataFrame:
    """One payment per order with lines; every fiftieth order is ten cents off."""
    lines = items(source)
    totals = lines.groupBy("order_id").agg(
        (amount_total(lines, "price") + amount_total(lines, "freight_value")).alias("_due")
    )
    off = F.when(F.col("order_id") % 50 == 0, F.lit("0.10")).otherwise(F.lit("0.00")).cast("decimal(4,2)")
    return totals.select(
        "order_id",
        F.lit(1).alias("payment_sequential"),
        F.lit("card").alias("payment_type"),
        (1 + F.col("order_id") % 10).cast("int").alias("payment_installments"),
        (F.col("_due") + off).cast("decimal(20,2)").alias("payment_value"),
    )


def _padded(column: str, width: int) -> Column:
    """Digits after a leading 1: text order is number order for values below 10^width."""
    return (F.col(column).cast("bigint") + F.lit(10**width)).cast("string")


def _review_id() -> Column:
    return F.concat_ws(
        "-", _padded("l_linenumber", 9), _padded("l_partkey", 15), _padded("l_suppkey", 15), _padded("l_quantity", 9)
    )


def raw_reviews(source: DriverTables) -> DataFrame:
    """One review per line, as text; the id is padded so that its text order is total and numeric."""
    moment = F.col("l_shipdate").cast("string")
    return source["lineitem"].select(
        _review_id().alias("review_id"),
        F.col("l_orderkey").alias("order_id"),
        (1 + F.col("l_quantity").cast("int") % 5).cast("string").alias("review_score"),
        F.lit("").alias("review_comment_title"),
        F.when(F.col("l_returnflag") == "N", "   ").otherwise(F.concat(F.lit(" "), "l_returnflag", F.lit(" "))).alias(
            "review_comment_message"
        ),
        moment.alias("review_creation_date"),
        moment.alias("review_answer_timestamp"),
    )


def reviews(source: DriverTables) -> DataFrame:
    """``raw_reviews`` already typed: the same rows as staging gives, without the way through text."""
    shown = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    return source["lineitem"].select(
        F.col("l_orderkey").alias("order_id"),
        _review_id().alias("review_id"),
        (1 + F.col("l_quantity").cast("int") % 5).alias("review_score"),
        F.lit(None).cast("string").alias("review_title"),
        shown.alias("review_message"),
        F.col("l_shipdate").alias("reviewed_at"),
        F.col("l_shipdate").alias("review_answered_at"),
    )


def _text(df: DataFrame, **columns: Column | str) -> DataFrame:
    return df.select(
        *[(F.col(c) if isinstance(c, str) else c).cast("string").alias(name) for name, c in columns.items()]
    )


def _raw_orders(source: DriverTables) -> DataFrame:
    return _text(
        orders(source),
        order_id="order_id",
        customer_id="customer_id",
        order_status="order_status",
        order_purchase_timestamp="purchased_at",
        order_approved_at="approved_at",
        order_delivered_carrier_date="shipped_at",
        order_delivered_customer_date="delivered_at",
        order_estimated_delivery_date=F.concat(F.col("estimated_delivery_date").cast("string"), F.lit(" 00:00:00")),
    )


def _raw_order_items(source: DriverTables) -> DataFrame:
    return _text(
        items_with_limit(source),
        order_id="order_id",
        order_item_id="order_item_id",
        product_id="product_id",
        seller_id="seller_id",
        shipping_limit_date="shipping_limit_at",
        price="price",
        freight_value="freight_value",
    )


def _raw_order_payments(source: DriverTables) -> DataFrame:
    paid = payments(source)
    return _text(paid, **{name: name for name in paid.columns})


def _raw_order_reviews(source: DriverTables) -> DataFrame:
    written = raw_reviews(source)
    return _text(written, **{name: name for name in written.columns})


def _raw_customers(source: DriverTables) -> DataFrame:
    return _text(
        customers(source),
        customer_id="customer_id",
        customer_unique_id="customer_unique_id",
        customer_zip_code_prefix="zip_prefix",
        customer_city="city",
        customer_state=F.lower("state"),
    )


def _raw_sellers(source: DriverTables) -> DataFrame:
    return _text(
        sellers(source),
        seller_id="seller_id",
        seller_zip_code_prefix="zip_prefix",
        seller_city="city",
        seller_state=F.lower("state"),
    )


def _raw_products(source: DriverTables) -> DataFrame:
    return _text(
        raw_products(source),
        product_id="product_id",
        product_category_name="product_category_name",
        product_name_lenght=F.lit(None),
        product_description_lenght=F.lit(None),
        product_photos_qty="product_photos_qty",
        product_weight_g="product_weight_g",
        product_length_cm=F.lit(None),
        product_height_cm=F.lit(None),
        product_width_cm=F.lit(None),
    )


RAW_TABLES = {
    "orders": _raw_orders,
    "order_items": _raw_order_items,
    "order_payments": _raw_order_payments,
    "order_reviews": _raw_order_reviews,
    "customers": _raw_customers,
    "sellers": _raw_sellers,
    "products": _raw_products,
    "category_translation": category_translation,
}


def raw_table(source: DriverTables, name: str) -> DataFrame:
    """A raw table as text under the raw column names, as a CSV file would carry it."""
    return RAW_TABLES[name](source)
