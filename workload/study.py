"""The model relations over one folder of driver tables, each built from the least it needs."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from parcelwise import shaping
from parcelwise.plans import delivery, marts, model, promise, repeat, rolling, sellers, staging
from parcelwise.session import in_scope, materialised, new_place, shared, tune
from parcelwise.sources.tables import save_bucketed
from workload import params as p


class Study:
    """Lazy relations; a property is a plan, not a result."""

    def __init__(self, spark: SparkSession, folder: str, source: shaping.DriverTables | None = None):
        self.spark = tune(spark)
        self.source = source or shaping.DriverTables(spark, folder)

    @property
    def dealt(self) -> bool:
        return isinstance(self.source, shaping.DealtTables)

    @property
    def dealt_by(self) -> dict[str, str]:
        """The relations whose rows lie together by a column, and that column."""
        return dict.fromkeys(("stg_orders", "stg_order_items", "stg_order_reviews"), "order_id") if self.dealt else {}

    def raw(self, table: str) -> DataFrame:
        return shaping.raw_table(self.source, table)

    @property
    def raw_names(self) -> list[str]:
        return list(shaping.RAW_TABLES)

    @cached_property
    def orders(self) -> DataFrame:
        return shaping.orders(self.source)

    @cached_property
    def customers(self) -> DataFrame:
        return shaping.customers(self.source)

    @cached_property
    def sellers(self) -> DataFrame:
        return shaping.sellers(self.source)

    @cached_property
    def products(self) -> DataFrame:
        return staging.stg_products(
            shaping.raw_products(self.source), shaping.category_translation(self.source)
        )

    @cached_property
    def items(self) -> DataFrame:
        return shaping.items(self.source)

    @cached_property
    def items_with_limit(self) -> DataFrame:
        return shaping.items_with_limit(self.source)

    @cached_property
    def payments(self) -> DataFrame:
        return shaping.payments(self.source)

    @cached_property
    def all_reviews(self) -> DataFrame:
        return shaping.reviews(self.source)

    @cached_property
    def reviews(self) -> DataFrame:
        return staging.latest_review_per_order(self.all_reviews)

    @cached_property
    def timeline(self) -> DataFrame:
        return model.order_timeline(self.orders, self.customers)

    @cached_property
    def measured(self) -> DataFrame:
        """What analyses of delays and buyers start from."""
        return self.timeline

    @cached_property
    def sequence(self) -> DataFrame:
        return model.customer_order_sequence(self.timeline)

    @cached_property
    def enriched(self) -> DataFrame:
        return model.enriched_orders(self.timeline, self.items, self.payments, self.reviews)

    @cached_property
    def fct_orders(self) -> DataFrame:
        return model.fct_orders(self.enriched, self.sellers, self.sequence)

    @cached_property
    def reviewed(self) -> DataFrame:
        return model.with_reviews(self.timeline, self.reviews)

    @cached_property
    def reviewed_delivered(self) -> DataFrame:
        return delivery.with_delay_bucket(self.reviewed)

    @cached_property
    def routed(self) -> DataFrame:
        """Orders with amounts, only seller and its state, and review: all but payments and ranks."""
        return model.with_seller_state(
            model.with_reviews(model.with_single_seller(self.timeline, self.items), self.reviews), self.sellers
        )

    @cached_property
    def routed_delivered(self) -> DataFrame:
        return delivery.with_delay_bucket(self.routed)

    @cached_property
    def route_delays(self) -> DataFrame:
        """As ``routed_delivered``, without reviews."""
        return delivery.with_delay_bucket(
            model.with_seller_state(model.with_single_seller(self.timeline, self.items), self.sellers)
        )

    @cached_property
    def paid(self) -> DataFrame:
        return model.with_payments(model.with_single_seller(self.timeline, self.items), self.payments)

    @cached_property
    def dim_customers(self) -> DataFrame:
        return model.dim_customers(self.customers, self.measured)

    @cached_property
    def mart_delivery_promise(self) -> DataFrame:
        return marts.mart_delivery_promise(self.routed, p.MIN_ROUTE_ORDERS)

    @cached_property
    def mart_first_orders(self) -> DataFrame:
        return marts.mart_first_orders(self.routed, p.DATA_END, p.REPEAT_DAYS)

    @cached_property
    def first_orders(self) -> DataFrame:
        """First orders without the columns that would need items or reviews."""
        return marts.mart_first_orders(self.measured, p.DATA_END, p.REPEAT_DAYS)

    @cached_property
    def valued(self) -> DataFrame:
        return model.with_reviews(model.with_single_seller(self.timeline, self.items), self.reviews)

    @cached_property
    def mart_monthly(self) -> DataFrame:
        return marts.mart_monthly(self.valued, self.measured, p.PARTIAL_MONTH)

    @cached_property
    def mart_seller_delivery(self) -> DataFrame:
        return marts.mart_seller_delivery(self.items, self.reviewed, self.sellers)

    @cached_property
    def monthly_promise(self) -> DataFrame:
        return delivery.monthly_promise(self.reviewed_delivered, p.MONTHLY_START, p.MONTHLY_END)

    @cached_property
    def delay_vs_promise(self) -> DataFrame:
        return delivery.delay_vs_promise(self.reviewed_delivered)

    @cached_property
    def bad_review_timing(self) -> DataFrame:
        return delivery.bad_review_timing(self.reviewed_delivered)

    @cached_property
    def handover(self) -> DataFrame:
        return sellers.handover(self.measured, self.items_with_limit)

    @cached_property
    def handover_summary(self) -> DataFrame:
        return sellers.handover_summary(self.handover)

    @cached_property
    def seller_excess(self) -> DataFrame:
        return sellers.seller_excess(self.items, self.measured, self.sellers)

    @cached_property
    def flagged_sellers(self) -> DataFrame:
        return sellers.flag_excess_sellers(
            self.seller_excess, p.SELLER_MIN_ORDERS, p.SELLER_TIMES, p.SELLER_MIN_EXCESS
        )

    @cached_property
    def excess_summary(self) -> DataFrame:
        return sellers.excess_summary(self.flagged_sellers)

    @cached_property
    def seller_concentration(self) -> DataFrame:
        return sellers.seller_concentration(self.seller_excess, p.LATE_SHARE)

    @cached_property
    def cells(self) -> DataFrame:
        """Backtest cells with review counts, written once."""
        return materialised(promise.promise_cells(self.routed_delivered, p.CUTOFF))

    @cached_property
    def bad_rates(self) -> DataFrame:
        return promise.bad_rate_table(self.cells)

    @cached_property
    def calibrated(self) -> DataFrame:
        return promise.calibrate_routes(self.cells, p.QUANTILE)

    @cached_property
    def backtest(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Holdout cells, calibrated routes, global quantile, bad-review rates."""
        return (
            promise.holdout_cells(self.cells),
            self.calibrated,
            promise.global_quantile(self.cells, p.QUANTILE),
            self.bad_rates,
        )

    @cached_property
    def risky(self):
        return promise.is_risky(p.RISKY_MIN_ORDERS, p.RISKY_RATE)

    @cached_property
    def policies(self) -> DataFrame:
        rules = {
            "route_quantile": promise.quantile_promise(p.RISKY_MIN_ORDERS),
            f"risky_routes_plus_{p.MARGIN}": promise.margin_promise(self.risky, p.MARGIN),
        }
        return promise.evaluate_policies(*self.backtest, rules)

    @cached_property
    def cited_policy(self) -> DataFrame:
        return promise.evaluate_policy(
            f"risky_routes_plus_{p.MARGIN}", promise.margin_promise(self.risky, p.MARGIN), *self.backtest
        )

    @cached_property
    def margin_grid(self) -> DataFrame:
        return promise.margin_grid(*self.backtest, self.risky)

    def rolling(self, cells: DataFrame, by: tuple[str, ...]) -> DataFrame:
        return rolling.rolling_quantile(
            cells, p.ROLLING_START, p.ROLLING_END, by=by, window_days=p.ROLLING_DAYS, p=p.QUANTILE
        )

    @cached_property
    def rolling_policy(self) -> DataFrame:
        cells = materialised(rolling.delivery_cells(self.route_delays))
        return rolling.evaluate_rolling_policy(
            cells,
            self.rolling(cells, ()),
            self.rolling(cells, ("customer_state",)),
            p.CUTOFF,
            p.ROLLING_MIN_DELIVERIES,
            p.FOCUS_MONTH,
        )

    @cached_property
    def repeat_summary(self) -> DataFrame:
        return repeat.repeat_summary(self.first_orders)

    @cached_property
    def standardised_repeat(self) -> DataFrame:
        return repeat.state_standardised_repeat(self.first_orders, p.MIN_LATE)


class StoredStudy(Study):
    """A study over a written order fact: for results that read the orders several times.

    Inside a scope all results share one fact, which has the payments too; alone, a result writes what it needs. Over
    tables dealt by orders, what has a row per order is written in the same buckets.
    """

    def written(self, name: str, build: Callable[[], DataFrame], key: str | None = None) -> DataFrame:
        def write(table: DataFrame) -> DataFrame:
            return self.source.saved(f"written {name}".replace(" ", "_"), table, key) if key and self.dealt else materialised(table)

        return shared((self.source.folder, name), build, write)

    @cached_property
    def orders(self) -> DataFrame:
        orders = super().orders
        return self.written("orders", lambda: orders, "order_id") if in_scope() else orders

    @cached_property
    def reviews(self) -> DataFrame:
        reviews = super().reviews
        return self.written("reviews", lambda: reviews, "order_id") if in_scope() else reviews

    @cached_property
    def sellers(self) -> DataFrame:
        """Written where orders are dealt: a lookup in a table of known size need not move the orders."""
        sellers = super().sellers
        return self.written("sellers", lambda: sellers) if self.dealt else sellers

    @cached_property
    def routed(self) -> DataFrame:
        fact = super().routed
        if in_scope():
            return self.paid_fact
        return materialised(fact)

    @cached_property
    def paid_fact(self) -> DataFrame:
        """The order fact but for its ranks, from one sum of the lines."""
        counted = model.with_reviews(model.with_items(self.timeline, self.items), self.reviews)
        return self.written(
            "paid fact", lambda: model.with_seller_state(model.with_payments(counted, self.payments), self.sellers), "order_id"
        )

    @cached_property
    def measured(self) -> DataFrame:
        return self.routed

    @cached_property
    def valued(self) -> DataFrame:
        return self.routed

    @cached_property
    def reviewed(self) -> DataFrame:
        return self.routed

    @cached_property
    def route_delays(self) -> DataFrame:
        return self.routed_delivered


class ReportedStudy(StoredStudy):
    """A stored study that also writes the sellers' counts, which several results read."""

    @cached_property
    def seller_excess(self) -> DataFrame:
        excess = super().seller_excess
        return self.written("seller excess", lambda: excess)


class BuiltStudy(StoredStudy):
    """A study after a build: what several relations are made of is written, the relations themselves are read once."""

    @cached_property
    def orders(self) -> DataFrame:
        orders = super().orders
        return self.written("orders", lambda: orders, "order_id")

    @cached_property
    def reviews(self) -> DataFrame:
        reviews = super().reviews
        return self.written("reviews", lambda: reviews, "order_id")

    @cached_property
    def routed(self) -> DataFrame:
        return self.paid_fact

    @cached_property
    def paid(self) -> DataFrame:
        return self.routed

    @cached_property
    def fct_orders(self) -> DataFrame:
        """The published fact, which the checks are about: the written one with its ranks."""
        return model.ranked_fact(self.routed, model.ENRICHED_COLUMNS, self.sequence)


class BucketedStudy(Study):
    """A study over saved tables that share their buckets of orders: the fact is put together without an exchange."""

    @cached_property
    def saved(self) -> dict[str, DataFrame]:
        source = {
            "timeline": super().timeline,
            "items": super().items,
            "payments": super().payments,
            "reviews": super().all_reviews,
            "sequence": super().sequence.select("order_id", "order_rank"),
        }
        return save_bucketed(source, new_place(self.spark, "bucketed"), "order_id")

    @cached_property
    def enriched(self) -> DataFrame:
        kept = staging.latest_review_per_order(self.saved["reviews"])
        return model.enriched_orders(self.saved["timeline"], self.saved["items"], self.saved["payments"], kept)

    @cached_property
    def fct_orders(self) -> DataFrame:
        return model.fct_orders(self.enriched, self.sellers, self.saved["sequence"])
