"""Backtest of promise rules: calibrate before a cutoff, evaluate from it on.

Orders from ``with_delay_bucket`` are first counted into cells (route, promise, delay, ...). Every later step
works on counts whose number follows the calendar and the route grid, so the orders are read once, lookups are
cheap, and a dominant route is no hot key. Write the cells (``session.materialised``) when several steps follow.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.functions import bad_review, ratio
from parcelwise.operators.histograms import weighted_quantile, whole_days

ROUTE = ["seller_state", "customer_state"]
SUM_DIGITS = 6


def _from(cutoff: dt.date) -> Column:
    return F.col("purchased_at") >= F.lit(cutoff).cast("timestamp_ntz")


def holdout(delivered: DataFrame, cutoff: dt.date) -> DataFrame:
    """Single-seller delivered orders from the cutoff on."""
    return delivered.where(_from(cutoff) & F.col("seller_state").isNotNull())


def promise_cells(delivered: DataFrame, cutoff: dt.date) -> DataFrame:
    """All delivered orders as counts, calibration and holdout told apart by ``is_holdout``.

    One pass over the orders serves the whole backtest. Without a ``review_score`` column the review counts
    are left out.
    """
    counts = [F.count(F.lit(1)).alias("n_orders")]
    if "review_score" in delivered.columns:
        counts += [
            F.count("review_score").alias("reviewed"),
            F.count_if(bad_review()).alias("bad"),
        ]
    return delivered.groupBy(
        _from(cutoff).alias("is_holdout"), *ROUTE, "bucket", "promised_days", "actual_days", "is_late"
    ).agg(*counts)


def _calibration(cells: DataFrame) -> DataFrame:
    return cells.where(~F.col("is_holdout"))


def holdout_cells(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("is_holdout") & F.col("seller_state").isNotNull())


def bad_rate_table(cells: DataFrame) -> DataFrame:
    """Bad-review rate by delay class and lateness before the cutoff; at most three rows per class."""
    return (
        _calibration(cells)
        .where(F.col("reviewed") > 0)
        .groupBy("bucket", "is_late")
        .agg(ratio(F.sum("bad"), F.sum("reviewed")).alias("bad_rate"))
    )


def calibrate_routes(cells: DataFrame, p: float = 0.93) -> DataFrame:
    """Orders, late rate and delay quantile per route before the cutoff; single-seller orders only."""
    timed = F.when(F.col("is_late").isNotNull(), F.col("n_orders"))
    late = F.when(F.col("is_late"), F.col("n_orders")).when(~F.col("is_late"), F.lit(0))
    return (
        _calibration(cells)
        .where(F.col("seller_state").isNotNull())
        .groupBy(*ROUTE)
        .agg(
            F.sum("n_orders").alias("n"),
            ratio(F.sum(late), F.sum(timed)).alias("late_rate"),
            weighted_quantile("actual_days", p, "n_orders").alias("q"),
        )
    )


def global_quantile(cells: DataFrame, p: float = 0.93) -> DataFrame:
    """One row: the delay quantile of all delivered orders before the cutoff, several sellers or not."""
    counts = _calibration(cells).groupBy("actual_days").agg(F.sum("n_orders").alias("n_orders"))
    return counts.agg(weighted_quantile("actual_days", p, "n_orders").alias("global_q"))


def is_risky(min_orders: int = 30, above: float = 0.08) -> Column:
    """Rule over calibrated routes; a route unseen in calibration is not risky."""
    return F.coalesce((F.col("n") >= min_orders) & (F.col("late_rate") > above), F.lit(False))


def risky_routes(routes: DataFrame, rule: Column) -> DataFrame:
    """One row: routes under the rule and their calibration orders (null when there is none)."""
    return routes.where(rule).agg(F.count(F.lit(1)).alias("routes"), F.sum("n").alias("calibration_orders"))


def quantile_promise(min_orders: int = 30) -> Column:
    """Policy: the route's quantile in whole days, the global one where the route has too few orders."""
    return whole_days(F.when(F.col("n") >= min_orders, F.col("q")).otherwise(F.col("global_q")))


def margin_promise(rule: Column, margin: int) -> Column:
    """Policy: ``margin`` more days on the routes under the rule."""
    return (F.col("promised_days") + F.when(rule, F.lit(margin)).otherwise(F.lit(0))).cast("double")


def evaluate_policies(
    cells: DataFrame,
    routes: DataFrame,
    global_q: DataFrame,
    bad_rates: DataFrame,
    policies: Mapping[str, Column],
) -> DataFrame:
    """One row per policy: mean promise, late rate and expected bad reviews, before and after.

    ``cells`` are the holdout's. A policy is a column over ``promised_days``, the calibrated ``n``, ``late_rate`` and ``q`` of the route and
    ``global_q``. All policies share one pass over the holdout cells.
    """
    offers = F.array(
        *[F.struct(F.lit(name).alias("policy"), promise.alias("new_promise")) for name, promise in policies.items()]
    )
    offered = (
        cells.join(routes, ROUTE, "left")
        .withColumn("global_q", global_q.scalar())
        .select(
            "bucket",
            "promised_days",
            "actual_days",
            F.col("is_late").alias("old_late"),
            "n_orders",
            "reviewed",
            F.inline(offers),
        )
        .withColumn("new_late", F.col("actual_days") > F.col("new_promise"))
        # Per policy, a handful of rows is left before the lookups.
        .groupBy("policy", "bucket", "old_late", "new_late")
        .agg(
            F.sum("n_orders").alias("orders"),
            F.sum("reviewed").alias("reviewed"),
            F.sum(F.col("n_orders") * F.col("promised_days")).alias("old_days"),
            F.sum(F.when(F.col("promised_days").isNotNull(), F.col("n_orders"))).alias("old_promises"),
            F.sum(F.col("n_orders") * F.col("new_promise")).alias("new_days"),
            F.sum(F.when(F.col("new_promise").isNotNull(), F.col("n_orders"))).alias("new_promises"),
        )
    )
    # bad_rate_table has at most three rows per delay class.
    rated = offered
    for which in ("old", "new"):
        rates = bad_rates.select("bucket", F.col("is_late").alias(f"{which}_late"), F.col("bad_rate").alias(f"{which}_rate"))
        rated = rated.join(F.broadcast(rates), ["bucket", f"{which}_late"], "left")

    def late_share(flag: str) -> Column:
        timed = F.when(F.col(flag).isNotNull(), F.col("orders"))
        return ratio(F.sum(F.when(F.col(flag), F.col("orders")).when(~F.col(flag), F.lit(0))), F.sum(timed))

    def expected_bad(rate: str) -> Column:
        reviewed = F.when(F.col("reviewed") > 0, F.col("reviewed"))
        return F.round(F.sum(reviewed * F.col(rate)), SUM_DIGITS)

    return rated.groupBy("policy").agg(
        F.sum("orders").alias("orders"),
        ratio(F.sum("old_days"), F.sum("old_promises")).alias("old_promise"),
        ratio(F.sum("new_days"), F.sum("new_promises")).alias("new_promise"),
        late_share("old_late").alias("old_late_rate"),
        late_share("new_late").alias("new_late_rate"),
        expected_bad("old_rate").alias("old_bad_reviews"),
        expected_bad("new_rate").alias("new_bad_reviews"),
    )


def evaluate_policy(
    name: str,
    promise: Column,
    cells: DataFrame,
    routes: DataFrame,
    global_q: DataFrame,
    bad_rates: DataFrame,
) -> DataFrame:
    """``evaluate_policies`` for a single rule."""
    return evaluate_policies(cells, routes, global_q, bad_rates, {name: promise})


def _margin_counts(cells: DataFrame, routes: DataFrame, rule: Column) -> DataFrame:
    """Holdout counts per delay class, rule, old lateness and days over the promise: what any margin is read from."""
    days = F.col("n_orders") * F.col("promised_days")
    return (
        cells.join(routes, ROUTE, "left")
        .groupBy(
            "bucket",
            rule.alias("_risky"),
            F.col("is_late").alias("_old_late"),
            (F.col("actual_days") - F.col("promised_days")).cast("long").alias("_over"),
        )
        .agg(
            F.sum("n_orders").alias("orders"),
            F.sum("reviewed").alias("reviewed"),
            F.sum(days).alias("promised"),
            F.sum(F.when(F.col("promised_days").isNotNull(), F.col("n_orders"))).alias("promises"),
        )
    )


def margin_grid(
    cells: DataFrame,
    routes: DataFrame,
    global_q: DataFrame,
    bad_rates: DataFrame,
    rule: Column,
    margins: Sequence[int] = tuple(range(11)),
    compat_rounding: bool = False,
) -> DataFrame:
    """Effect of each margin on the risky routes; the holdout is read once for all margins.

    An order is late under a margin if it was delivered more days after the promise than the margin (none on other
    routes). So the holdout is counted by days over the promise once, running totals from the latest orders down give
    the late ones of every margin, and a margin is a place in them: no holdout row is copied for it.
    The avoided share and the extra days come from unrounded figures; with ``compat_rounding`` from figures as they are
    published: days rounded to two decimals, rates and shares to four, bad reviews to whole numbers. ``global_q`` is not
    needed and only kept for callers.
    """

    def shown(value: Column, digits: int) -> Column:
        return F.round(value, digits) if compat_rounding else value

    counts = _margin_counts(cells, routes, rule)
    # Orders without a delay are never late nor on time; those of other routes do not depend on the margin.
    fixed = F.when(~F.col("_risky"), F.when(F.col("_over") > 0, F.lit(True)).when(F.col("_over") <= 0, F.lit(False)))
    rates = F.broadcast(bad_rates.select("bucket", "is_late", "bad_rate"))  # at most three rows per delay class
    per_class = (
        counts.withColumn("_fixed", fixed)
        .groupBy("bucket")
        .agg(
            F.sum(F.when(F.col("_fixed"), F.col("orders"))).alias("late"),
            F.sum(F.when(F.col("_fixed"), F.col("reviewed"))).alias("late_reviewed"),
            F.sum(F.when(F.col("_over").isNotNull(), F.col("orders"))).alias("timed"),
            F.sum(F.when(F.col("_over").isNotNull(), F.col("reviewed"))).alias("timed_reviewed"),
            F.sum("orders").alias("orders"),
            F.sum(F.when(F.col("_old_late"), F.col("orders"))).alias("old_late"),
            F.sum(F.when(F.col("_old_late").isNotNull(), F.col("orders"))).alias("old_timed"),
            F.sum("promised").alias("promised"),
            F.sum("promises").alias("promises"),
            F.sum(F.when(F.col("_risky"), F.col("promises"))).alias("moved"),
            F.collect_list(
                F.when(
                    F.col("_risky") & F.col("_over").isNotNull(), F.struct(F.col("_over").alias("over"), "orders", "reviewed")
                )
            ).alias("_risky_counts"),
        )
    )
    wanted = F.array(*[F.lit(margin).cast("long") for margin in margins])
    none = F.lit(None).cast("long")
    # Places in the running totals: a margin stands before the orders that are exactly that many days over.
    probes = F.transform(wanted, lambda m: F.struct(m.alias("over"), none.alias("orders"), none.alias("reviewed")))
    downwards = (
        Window.partitionBy("bucket").orderBy(F.desc("over"), F.col("_risky_orders").isNotNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    curve = (
        per_class.select("*", F.inline(F.concat("_risky_counts", probes)).alias("over", "_risky_orders", "_risky_reviewed"))
        .withColumn("_late", F.coalesce("late", F.lit(0)) + F.coalesce(F.sum("_risky_orders").over(downwards), F.lit(0)))
        .withColumn(
            "_late_reviewed",
            F.coalesce("late_reviewed", F.lit(0)) + F.coalesce(F.sum("_risky_reviewed").over(downwards), F.lit(0)),
        )
        .where(F.col("_risky_orders").isNull())
        .withColumn("_on_time_reviewed", F.coalesce("timed_reviewed", F.lit(0)) - F.col("_late_reviewed"))
    )
    for flag, name in ((True, "_late"), (False, "_on_time")):
        of_class = rates.where(F.col("is_late") == flag).select("bucket", F.col("bad_rate").alias(f"{name}_rate"))
        curve = curve.join(F.broadcast(of_class), "bucket", "left")  # one row per delay class

    def expected(name: str) -> Column:
        reviewed = F.col(f"{name}_reviewed")
        return F.when(reviewed > 0, reviewed * F.col(f"{name}_rate"))

    margin = F.col("over")
    bad = F.sum(expected("_late")), F.sum(expected("_on_time"))
    moved = F.coalesce(F.sum("moved"), F.lit(0)) * margin
    old_promise = shown(ratio(F.sum("promised"), F.sum("promises")), 2)
    new_promise = shown(ratio(F.sum("promised") + moved, F.sum("promises")), 2)
    new_late_rate = shown(ratio(F.sum("_late"), F.sum("timed")), 4)
    old_late_rate = shown(ratio(F.coalesce(F.sum("old_late"), F.lit(0)), F.sum("old_timed")), 4)
    return (
        curve.groupBy("over")
        .agg(
            F.sum("orders").alias("orders"),
            new_promise.alias("new_promise"),
            shown(new_promise - old_promise, 2).alias("extra_days"),
            new_late_rate.alias("new_late_rate"),
            shown(F.lit(1.0) - F.try_divide(new_late_rate, old_late_rate), 4).alias("late_avoided_share"),
            F.round(
                F.when(bad[0].isNotNull() | bad[1].isNotNull(), F.coalesce(bad[0], F.lit(0.0)) + F.coalesce(bad[1], F.lit(0.0))),
                0 if compat_rounding else SUM_DIGITS,
            ).alias("new_bad_reviews"),
        )
        .withColumnRenamed("over", "margin")
        .orderBy("margin")
    )
