"""The registered queries: name -> function of (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise import shaping
from parcelwise.plans import delivery, model, promise, publish, quality, rolling, routes, sellers, staging
from parcelwise.session import kept, materialised, new_place, scope
from parcelwise.sources import calendar, manifest, raw, tables
from workload import params as p
from workload.study import BucketedStudy, BuiltStudy, ReportedStudy, StoredStudy, Study

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Callable[[Study], DataFrame]] = {}
STUDIES: dict[str, type[Study]] = {}


def query(build: Callable[[Study], DataFrame]) -> Callable[[Study], DataFrame]:
    REGISTRY[build.__name__] = build
    return build


def stored_query(build: Callable[[Study], DataFrame]) -> Callable[[Study], DataFrame]:
    """A query that reads the order fact more than once, and therefore from a written table."""
    STUDIES[build.__name__] = StoredStudy
    return query(build)


def reported_query(build: Callable[[Study], DataFrame]) -> Callable[[Study], DataFrame]:
    """A query over the results of the analyses, each of them written first."""
    STUDIES[build.__name__] = ReportedStudy
    return query(build)


def built_query(build: Callable[[Study], DataFrame]) -> Callable[[Study], DataFrame]:
    """A query over all relations, each written first."""
    STUDIES[build.__name__] = BuiltStudy
    return query(build)


def registered() -> dict[str, Query]:
    def bound(build: Callable[[Study], DataFrame]) -> Query:
        study = STUDIES.get(build.__name__, Study)
        return lambda spark, folder: build(study(spark, folder))

    return {name: bound(build) for name, build in REGISTRY.items()}


# Staging: text tables to typed tables.


@query
def stg_orders(s: Study) -> DataFrame:
    return staging.stg_orders(s.raw("orders"))


@query
def stg_order_items(s: Study) -> DataFrame:
    return staging.stg_order_items(s.raw("order_items"))


@query
def stg_order_payments(s: Study) -> DataFrame:
    return staging.stg_order_payments(s.raw("order_payments"), p.PAYMENT_TYPE)


@query
def stg_customers(s: Study) -> DataFrame:
    return staging.stg_customers(s.raw("customers"))


@query
def stg_sellers(s: Study) -> DataFrame:
    return staging.stg_sellers(s.raw("sellers"))


@query
def stg_products(s: Study) -> DataFrame:
    return staging.stg_products(s.raw("products"), s.raw("category_translation"))


@query
def stg_order_reviews(s: Study) -> DataFrame:
    return staging.stg_order_reviews(s.raw("order_reviews"))


# Model.


@query
def order_item_rollup(s: Study) -> DataFrame:
    return model.order_item_rollup(s.items)


@query
def order_payment_rollup(s: Study) -> DataFrame:
    return model.order_payment_rollup(s.payments)


@query
def enriched_orders(s: Study) -> DataFrame:
    return s.enriched


@query
def customer_order_sequence(s: Study) -> DataFrame:
    return s.sequence


@query
def fct_orders(s: Study) -> DataFrame:
    return s.fct_orders


@query
def fct_orders_saved(s: Study) -> DataFrame:
    """The order fact from tables saved in buckets of orders."""
    return BucketedStudy(s.spark, s.source.folder).fct_orders


@query
def fct_order_items(s: Study) -> DataFrame:
    return model.fct_order_items(s.items_with_limit)


@query
def dim_customers(s: Study) -> DataFrame:
    return s.dim_customers


@query
def dim_sellers(s: Study) -> DataFrame:
    return model.dim_sellers(s.sellers)


@query
def dim_products(s: Study) -> DataFrame:
    return model.dim_products(s.products)


# Marts.


@query
def mart_delivery_promise(s: Study) -> DataFrame:
    return s.mart_delivery_promise


@query
def mart_first_orders(s: Study) -> DataFrame:
    return s.mart_first_orders


@query
def mart_monthly(s: Study) -> DataFrame:
    return s.mart_monthly


@query
def mart_seller_delivery(s: Study) -> DataFrame:
    return s.mart_seller_delivery


# Delivery and reviews.


@query
def scope_summary(s: Study) -> DataFrame:
    return delivery.scope_summary(s.reviewed)


@query
def with_delay_bucket(s: Study) -> DataFrame:
    return delivery.with_delay_bucket(s.measured).select("order_id", "actual_days", "is_late", "bucket")


@query
def monthly_promise(s: Study) -> DataFrame:
    return s.monthly_promise


@query
def late_peaks(s: Study) -> DataFrame:
    return delivery.late_peaks(s.monthly_promise, p.PEAK_RATE)


@query
def delay_vs_promise(s: Study) -> DataFrame:
    return s.delay_vs_promise


@query
def bad_review_timing(s: Study) -> DataFrame:
    return s.bad_review_timing


# Sellers and routes.


@query
def handover(s: Study) -> DataFrame:
    return s.handover


@query
def handover_summary(s: Study) -> DataFrame:
    return s.handover_summary


@query
def order_sellers(s: Study) -> DataFrame:
    return sellers.order_sellers(s.items, s.reviewed, s.sellers)


@query
def seller_excess(s: Study) -> DataFrame:
    return s.seller_excess.withColumn("expected", F.round("expected", 6))


@query
def flag_excess_sellers(s: Study) -> DataFrame:
    return s.flagged_sellers.select(
        "seller_id", "orders", "late", F.round("expected", 6).alias("expected"), F.round("excess", 6).alias("excess")
    )


@query
def excess_summary(s: Study) -> DataFrame:
    return s.excess_summary


@query
def seller_concentration(s: Study) -> DataFrame:
    return s.seller_concentration


@query
def route_table(s: Study) -> DataFrame:
    return routes.route_table(s.mart_delivery_promise, hot_rate=p.HOT_ROUTE_RATE)


@query
def route_table_for_state(s: Study) -> DataFrame:
    return routes.route_table(
        s.mart_delivery_promise, f" {p.ROUTE_STATE.lower()}", "late_rate", ascending=True, hot_rate=p.HOT_ROUTE_RATE
    )


# Promise backtest.


@query
def bad_rate_table(s: Study) -> DataFrame:
    """Bad-review rates need no routes, so the cells here have none."""
    unrouted = s.reviewed_delivered.withColumn("seller_state", F.lit(None).cast("string"))
    return promise.bad_rate_table(promise.promise_cells(unrouted, p.CUTOFF))


@query
def holdout(s: Study) -> DataFrame:
    return promise.holdout(s.route_delays, p.CUTOFF).select(
        "order_id", "seller_state", "customer_state", "promised_days", "actual_days", "is_late", "bucket"
    )


def _delay_cells(s: Study) -> DataFrame:
    """Backtest cells of a single use, without reviews."""
    return promise.promise_cells(s.route_delays, p.CUTOFF)


@query
def calibrate_routes(s: Study) -> DataFrame:
    return promise.calibrate_routes(_delay_cells(s), p.QUANTILE)


@query
def global_quantile(s: Study) -> DataFrame:
    return promise.global_quantile(_delay_cells(s), p.QUANTILE)


@query
def risky_routes(s: Study) -> DataFrame:
    return promise.risky_routes(promise.calibrate_routes(_delay_cells(s), p.QUANTILE), s.risky)


@query
def evaluate_policy(s: Study) -> DataFrame:
    return s.policies


@query
def margin_grid(s: Study) -> DataFrame:
    return s.margin_grid


@query
def margin_grid_rounded(s: Study) -> DataFrame:
    """The margin grid from rates and days as published."""
    return promise.margin_grid(*s.backtest, s.risky, compat_rounding=True)


@query
def margin_curve(s: Study) -> DataFrame:
    """The margin grid up to two months, from the same counts as for ten days."""
    return promise.margin_grid(*s.backtest, s.risky, range(p.CURVE_DAYS + 1))


@query
def rolling_quantile_by_state(s: Study) -> DataFrame:
    return s.rolling(rolling.delivery_cells(delivery.with_delay_bucket(s.measured)), ("customer_state",))


@query
def rolling_quantile_all(s: Study) -> DataFrame:
    return s.rolling(rolling.delivery_cells(delivery.with_delay_bucket(s.measured)), ())


@query
def evaluate_rolling_policy(s: Study) -> DataFrame:
    return s.rolling_policy


@query
def day_series_deliveries(s: Study) -> DataFrame:
    """Deliveries on each day of the rolling range, days without any included."""
    days = calendar.day_series(s.spark, p.ROLLING_START, p.ROLLING_END)
    per_day = (
        delivery.with_delay_bucket(s.measured)
        .groupBy(F.col("delivered_at").cast("date").alias("day"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return days.join(per_day, "day", "left").select("day", F.coalesce("_n", F.lit(0)).cast("long").alias("deliveries"))


# Repeat purchase.


@query
def repeat_summary(s: Study) -> DataFrame:
    return s.repeat_summary


@query
def state_standardised_repeat(s: Study) -> DataFrame:
    return s.standardised_repeat


# Quality.


@query
def pitfall_counts(s: Study) -> DataFrame:
    return pitfalls(s)


@query
def expect_unique_lines_per_order(s: Study) -> DataFrame:
    """Orders with several lines: a key that is known not to be unique."""
    return quality.unique(s.items, "order_id")


@query
def expect_unique_combination(s: Study) -> DataFrame:
    return quality.unique_combination(s.items, ["order_id", "order_item_id"])


@query
def expect_not_null_delivery(s: Study) -> DataFrame:
    return quality.not_null(s.orders, "delivered_at").select("order_id", "order_status")


@query
def expect_accepted_status(s: Study) -> DataFrame:
    return quality.accepted_values(s.orders, "order_status", ["delivered"])


@query
def expect_relationships(s: Study) -> DataFrame:
    """Orders without any line: orders against the order ids of the lines."""
    return quality.relationships(s.orders, "order_id", s.items.select("order_id").distinct(), "order_id")


@query
def expect_delivery_after_purchase(s: Study) -> DataFrame:
    return quality.delivery_after_purchase(s.measured)


@query
def expect_delivery_after_shipping(s: Study) -> DataFrame:
    """The same check with the shipping date as the start, which some orders are known to break."""
    return quality.delivery_after_purchase(s.orders.withColumn("purchased_at", F.col("shipped_at")))


@query
def expect_first_orders_cover_buyers(s: Study) -> DataFrame:
    return quality.first_orders_cover_buyers(s.dim_customers, s.first_orders)


@query
def expect_buyers_outside_eligible(s: Study) -> DataFrame:
    """Buyers whose first order is too recent to be eligible: the same anti join with a known result."""
    return quality.first_orders_cover_buyers(s.dim_customers, s.first_orders.where("is_eligible"))


@query
def expect_known_impossible_dates(s: Study) -> DataFrame:
    return quality.known_impossible_dates(s.orders)


@query
def expect_payments_match_items(s: Study) -> DataFrame:
    return quality.payments_match_items(s.paid, p.TOLERANCE)


def checked_tables(s: Study) -> dict[str, DataFrame]:
    """The relations that the declared checks are about, by name."""
    return {
        "stg_orders": s.orders,
        "stg_order_items": s.items,
        "stg_order_reviews": s.reviews,
        "stg_customers": s.customers,
        "stg_sellers": s.sellers,
        "stg_products": s.products,
        "fct_orders": s.fct_orders,
        "fct_order_items": model.fct_order_items(s.items_with_limit),
        "dim_customers": s.dim_customers,
        "dim_sellers": model.dim_sellers(s.sellers),
        "dim_products": model.dim_products(s.products),
        "mart_first_orders": s.first_orders,
        "mart_seller_delivery": s.mart_seller_delivery,
        "mart_monthly": s.mart_monthly,
    }


@built_query
def expectation_report(s: Study) -> DataFrame:
    """All checks over written tables, as they run after a build."""
    return quality.expectation_report(
        quality.study_expectations(checked_tables(s), p.IMPOSSIBLE_ALLOWED, p.MISMATCH_ALLOWED, s.dealt_by)
    )


# Publishing.


def monthly_metrics(months: DataFrame) -> DataFrame:
    return publish.metric_rows(months, "monthly", F.col("month"), [F.col("month").asc_nulls_last()])


def _ascending(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def derived(s: Study, compat_rounding: bool = False) -> DataFrame:
    return publish.derived_figures(
        s.delay_vs_promise,
        s.bad_review_timing,
        s.handover_summary,
        s.seller_concentration,
        s.excess_summary,
        s.cited_policy,
        min_late_orders=p.RATIO_MIN_LATE,
        compat_rounding=compat_rounding,
    )


def pitfalls(s: Study) -> DataFrame:
    return quality.pitfall_counts(s.orders, s.customers, s.all_reviews, s.paid, s.mart_monthly, p.TOLERANCE)


def study_metrics(s: Study) -> DataFrame:
    """Every figure of the study as one long table."""
    route = F.concat_ws(" ", "seller_state", "customer_state")
    delay_class = F.concat_ws(" ", "bucket", F.col("is_late").cast("string"))
    shortest_delay = [F.regexp_extract("bucket", r"^\d+", 0).cast("int"), F.col("is_late").asc_nulls_last()]
    declared = F.when(F.col("policy") == "route_quantile", 0).otherwise(1)
    rolling_rule = s.rolling_policy.select(
        F.lit(f"rolling_{p.ROLLING_DAYS}_days").alias("policy"), "orders", "new_promise", "new_late_rate", "focus_late_rate"
    )
    routes_by_size = [F.col("orders").desc_nulls_last(), *_ascending("seller_state", "customer_state")]
    sections = [
        publish.metric_rows(delivery.scope_summary(s.reviewed), "scope"),
        monthly_metrics(s.monthly_promise),
        publish.metric_rows(s.delay_vs_promise, "delay_vs_promise", delay_class, shortest_delay),
        publish.metric_rows(s.bad_review_timing, "bad_reviews"),
        publish.metric_rows(s.handover_summary, "handover"),
        publish.metric_rows(s.seller_concentration, "sellers"),
        publish.metric_rows(s.excess_summary, "sellers"),
        publish.metric_rows(s.mart_delivery_promise, "routes", route, routes_by_size),
        publish.metric_rows(promise.risky_routes(s.calibrated, s.risky), "backtest.risky_routes"),
        publish.metric_rows(s.policies, "backtest.policies", F.col("policy"), [declared]),
        # The third rule has other figures than the two before.
        publish.metric_rows(rolling_rule, "backtest.policies", F.col("policy")).withColumn("ordinal", F.lit(2).cast("long")),
        publish.metric_rows(s.margin_grid, "backtest.margins", F.col("margin"), _ascending("margin")),
        publish.metric_rows(s.rolling_policy, "backtest.rolling"),
        publish.metric_rows(s.repeat_summary, "repeat"),
        publish.metric_rows(s.standardised_repeat, "repeat.state_adjusted"),
        publish.metric_rows(derived(s), "derived"),
        publish.metric_rows(pitfalls(s), "pitfalls"),
    ]
    metrics = sections[0]
    for section in sections[1:]:
        metrics = metrics.unionByName(section)
    return publish.dated(metrics, p.DATA_END, p.CUTOFF)


@reported_query
def metrics_table(s: Study) -> DataFrame:
    """The whole study in one go: the order fact is built once, every analysis reads it."""
    return study_metrics(s)


@stored_query
def metrics_sink(s: Study) -> DataFrame:
    """Metrics written as JSON and read back."""
    path = new_place(s.spark, "metrics")
    scope = publish.metric_rows(delivery.scope_summary(s.reviewed), "scope")
    publish.write_metrics(scope.unionByName(monthly_metrics(s.monthly_promise)), path, "json")
    columns = "section string, key string, ordinal bigint, metric string, value double, text string"
    return s.spark.read.schema(columns).json(path)


@reported_query
def derived_figures(s: Study) -> DataFrame:
    return derived(s)


@reported_query
def derived_figures_rounded(s: Study) -> DataFrame:
    """The derived figures from rates and days as published."""
    return derived(s, compat_rounding=True)


@query
def results_in_scope(s: Study) -> DataFrame:
    """Metrics per section, derived figures and checks of one scope: they share a written fact, which goes with the scope.

    Orders and lines are dealt into buckets of orders once, so none of them moves them again by order.
    """
    with scope(s.spark), shaping.dealt(s.source) as dealt:
        study = ReportedStudy(s.spark, s.source.folder, dealt)
        results = [
            study_metrics(study).groupBy(F.col("section").alias("name")).agg(F.count(F.lit(1)).alias("rows")),
            derived(study).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("derived figures").alias("name"), "rows"),
            expectation_report(BuiltStudy(s.spark, s.source.folder, dealt))
            .groupBy(F.concat_ws(" ", F.lit("checks"), "status").alias("name"))
            .agg(F.count(F.lit(1)).alias("rows")),
        ]
        return kept(results[0].unionByName(results[1]).unionByName(results[2]))


def published_pages(metrics: DataFrame) -> DataFrame:
    """A page per month with two figures and one without a metric; every fifth page has one order too many."""
    wrong = F.when(F.col("_i") % 5 == 0, 1).otherwise(0)
    late = F.regexp_replace(F.round(F.col("late_rate") * 100, 1).cast("decimal(6,1)").cast("string"), r"\.", ",")
    by_month = metrics.groupBy(F.col("key"), F.col("ordinal").cast("int").alias("_i")).agg(
        F.max(F.when(F.col("metric") == "orders", F.col("value"))).cast("long").alias("orders"),
        F.max(F.when(F.col("metric") == "late_rate", F.col("value"))).alias("late_rate"),
    )
    figures = [
        F.format_string('<b data-k="monthly.%d.orders" data-f="int">%d</b>', F.col("_i"), F.col("orders") + wrong),
        F.format_string('<b data-k="monthly.%d.late_rate" data-f="pct">%s&nbsp;%%</b>', F.col("_i"), late),
        F.format_string('<i data-k="monthly.%d.refunds" data-f="int">0</i>', F.col("_i")),
        F.when(F.col("_i") % 2 == 0, F.lit('<p class="updated">')),
    ]
    return by_month.select(F.col("key").alias("page"), F.concat_ws("\n", *figures).alias("html"))


@query
def reconcile_published(s: Study) -> DataFrame:
    metrics = materialised(monthly_metrics(s.monthly_promise))
    return publish.reconcile_published(published_pages(metrics), metrics).select(
        "page", "key", "format", "shown", "problem"
    )


@query
def published_entities(s: Study) -> DataFrame:
    """Figures of pages that write them with character references of all kinds."""
    shown = "&#8722;%d&#8239;&#x26;nbsp;&euro; &#xE9;&copy1 &Eacute;t&eacute;&thinsp;&#128;&#x1F69A;&unknown;&#0;"
    figure = F.format_string(f'<b data-k="monthly.orders" data-f="int">{shown}</b>', "orders")
    pages = s.monthly_promise.select(F.col("month").alias("page"), figure.alias("html"))
    return publish.published_figures(pages).select("page", "key", publish.plain_text(F.col("shown")).alias("text"))


@query
def update_notice_mismatch(s: Study) -> DataFrame:
    return publish.update_notice_mismatch(
        published_pages(monthly_metrics(s.monthly_promise)), p.DATA_END, p.DATA_END
    )


def _snapshot_diff(s: Study) -> DataFrame:
    """Monthly figures of late orders from the cutoff on, against a snapshot that ends at the cutoff."""
    before = delivery.monthly_promise(s.reviewed_delivered, p.MONTHLY_START, p.CUTOFF)
    recent = F.col("purchased_at") >= F.lit(p.CUTOFF).cast("timestamp_ntz")
    mixed = delivery.monthly_promise(
        s.reviewed_delivered.where(F.col("is_late") | ~recent), p.MONTHLY_START, p.MONTHLY_END
    )
    return publish.metrics_snapshot_diff(monthly_metrics(mixed), monthly_metrics(before))


@stored_query
def metrics_snapshot_diff(s: Study) -> DataFrame:
    return _snapshot_diff(s)


@stored_query
def publication_date(s: Study) -> DataFrame:
    return publish.publication_date(_snapshot_diff(s), p.CUTOFF, p.DATA_END)


# Sources and sinks.


# Packed files are read by one task each, so they must not grow with the tables.
ROWS_PER_PACKED_FILE = 1_000_000


def _csv_files(s: Study, packed: bool = True) -> dict[str, str]:
    """The raw tables written as CSV text into a new shared place, ``packed`` as gzip files of bounded size.

    Plain text takes about six times the disk.
    """
    base = new_place(s.spark, "csv")
    options = {"header": True, "escape": '"'}
    if packed:
        options |= {"compression": "gzip", "maxRecordsPerFile": ROWS_PER_PACKED_FILE}
    for table in s.raw_names:
        s.raw(table).write.options(**options).csv(f"{base}/{table}")
    return {table: f"{base}/{table}/*.csv{'.gz' if packed else ''}" for table in s.raw_names}


@query
def csv_to_orders(s: Study) -> DataFrame:
    """The whole way in: CSV text, contract, landing, staging, enriched orders."""
    landed = raw.load_raw(s.spark, _csv_files(s), new_place(s.spark, "landed"))
    timeline = model.order_timeline(
        staging.stg_orders(landed["orders"]), staging.stg_customers(landed["customers"])
    )
    return model.enriched_orders(
        timeline,
        staging.stg_order_items(landed["order_items"]),
        staging.stg_order_payments(landed["order_payments"], p.PAYMENT_TYPE),
        staging.stg_order_reviews(landed["order_reviews"]),
    )


@query
def replaced_tables(s: Study) -> DataFrame:
    """Two tables replaced together, a replacement that fails half way, and what readers then find."""
    place = new_place(s.spark, "replaced")
    both = {"sellers": model.dim_sellers(s.sellers), "customers": s.customers}
    tables.save_tables({name: df.limit(0) for name, df in both.items()}, place)
    tables.save_tables(both, place)
    fails = s.customers.withColumn("state", F.raise_error(F.lit("no more space")).cast("string"))
    with suppress(Exception):
        tables.save_tables({"sellers": both["sellers"].limit(0), "customers": fails}, place)
    found = tables.open_tables(s.spark, place, list(both))
    return (
        found["customers"]
        .groupBy("state")
        .agg(F.count(F.lit(1)).alias("customers"))
        .join(found["sellers"].groupBy("state").agg(F.count(F.lit(1)).alias("sellers")), "state", "full")
    )


@query
def csv_line_breaks(s: Study) -> DataFrame:
    """Texts with line breaks and quotes, written as CSV and read again by many tasks."""
    breaks = F.expr("repeat('\n', cast(o_orderkey % 4 as int))")
    comment = F.concat(F.lit("priority"), breaks, F.lit('"'), "o_orderpriority", F.lit('",\r\n'), "o_orderstatus")
    place = f"{new_place(s.spark, 'csv')}/comments"
    written = s.source["orders"].select(F.col("o_orderkey").cast("string").alias("order_id"), comment.alias("comment"))
    written.write.options(header=True, escape='"', quoteAll=True).csv(place)
    found = raw.read_csv_text(s.spark, f"{place}/*.csv")
    return found.select(F.col("order_id").cast("long").alias("order_id"), "comment")


@query
def load_manifest(s: Study) -> DataFrame:
    """Rows per loaded table, after a load whose digests are checked against the files."""
    files, place = _csv_files(s), new_place(s.spark, "landed")
    expected = None
    for path in files.values():
        found = manifest.file_digests(s.spark, path)
        expected = found if expected is None else expected.unionByName(found)
    raw.load_raw(s.spark, files, place, expected_digests=expected)
    listed = s.spark.read.parquet(f"{place}/manifest")
    return listed.groupBy("source").agg(F.sum("rows").alias("rows"))


@query
def changed_files(s: Study) -> DataFrame:
    """Tables of which a file no longer has the digest it was listed with: the products' files were listed wrongly."""
    listed = found = None
    for table, path in _csv_files(s).items():
        digests = manifest.file_digests(s.spark, path).withColumn("source", F.lit(table))
        wrong = F.when(F.col("source") == "products", F.reverse("sha256")).otherwise(F.col("sha256"))
        before = digests.withColumn("sha256", wrong)
        found = digests if found is None else found.unionByName(digests)
        listed = before if listed is None else listed.unionByName(before)
    return manifest.check_digests(found, listed).select("source").distinct()


@query
def row_counts(s: Study) -> DataFrame:
    """Rows and columns per shaped source relation."""
    counts = None
    for name in s.raw_names:
        df = s.raw(name)
        width = raw.describe(df).agg(F.count(F.lit(1)))
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("source"), "rows", width.scalar().alias("columns")
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query
def sql_over_views(s: Study) -> DataFrame:
    """Relations registered by name and queried with SQL."""
    tables.register_views({"stg_customers": s.customers, "stg_orders": s.orders})
    return s.spark.sql(
        """
        SELECT c.state, o.order_status, count(*) AS orders
        FROM stg_orders o JOIN stg_customers c USING (customer_id)
        GROUP BY c.state, o.order_status
        """
    )


@query
def saved_marts(s: Study) -> DataFrame:
    """Two marts written, partitioned by month or not, and read back joined to the calendar."""
    place = new_place(s.spark, "marts")
    tables.save_tables(
        {"mart_monthly": s.mart_monthly, "dim_sellers": model.dim_sellers(s.sellers)},
        place,
        partition_by={"dim_sellers": ["state"]},
    )
    saved = tables.open_tables(s.spark, place, ["mart_monthly", "dim_sellers"])
    sellers_known = saved["dim_sellers"].agg(F.count(F.lit(1)))
    return saved["mart_monthly"].select("month", "orders", "gmv", sellers_known.scalar().alias("sellers"))
