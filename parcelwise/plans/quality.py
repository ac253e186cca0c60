"""Data-quality expectations as queries for violating rows, a report over them, and the pitfall counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The order statuses and review scores the source may contain.
ORDER_STATUSES = ["delivered", "shipped", "canceled", "unavailable", "invoiced", "processing", "created", "approved"]
REVIEW_SCORES = [1, 2, 3, 4, 5]

# Known faults of the original archive (orders with impossible dates, payments off).
KNOWN_IMPOSSIBLE_DATES = 189
KNOWN_PAYMENT_MISMATCHES = 260
PAYMENT_TOLERANCE = 0.05


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once; nulls do not count."""
    return unique_combination(df.where(F.col(column).isNotNull()), [column])


def unique_combination(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Combinations that occur more than once."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values outside the list, with their row counts; nulls pass."""
    unexpected = F.col(column).isNotNull() & ~F.col(column).isin(list(values))
    return df.where(unexpected).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def relationships(child: DataFrame, foreign_key: str, parent: DataFrame, key: str) -> DataFrame:
    """Foreign keys without a parent row, with their row counts.

    Child rows are counted per key before the join, so a key that holds most rows is one row there.
    """
    used = (
        child.where(F.col(foreign_key).isNotNull())
        .groupBy(F.col(foreign_key).alias(foreign_key))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    known = parent.select(F.col(key).alias("_known"))
    return used.join(known, used[foreign_key] == known["_known"], "left_anti")


def _delivered_before_purchase() -> Column:
    return F.col("delivered_at") < F.col("purchased_at")


def delivery_after_purchase(orders: DataFrame) -> DataFrame:
    return orders.where(_delivered_before_purchase()).select("order_id")


def _impossible_dates() -> Column:
    return (F.col("shipped_at") < F.col("purchased_at")) | (F.col("delivered_at") < F.col("shipped_at"))


def known_impossible_dates(orders: DataFrame) -> DataFrame:
    """Shipped before purchase or delivered before shipping; an order with both faults is one row."""
    return orders.where(_impossible_dates()).select("order_id")


def _payment_off(tolerance: float) -> Column:
    # The tolerance as a decimal: amounts stay exact.
    gap = F.abs(F.col("items_value") + F.col("freight_value") - F.col("payment_value"))
    return gap > F.lit(str(tolerance)).cast("decimal(10,4)")


def payments_match_items(orders: DataFrame, tolerance: float = PAYMENT_TOLERANCE) -> DataFrame:
    """Orders whose payment differs from items plus freight by more than the tolerance."""
    return orders.where(_payment_off(tolerance)).select(
        "order_id", (F.col("items_value") + F.col("freight_value")).cast("decimal(20,2)").alias("expected"), "payment_value"
    )


def first_orders_cover_buyers(people: DataFrame, first_orders: DataFrame) -> DataFrame:
    """People with a delivered order who have no first order."""
    return (
        people.where(F.col("delivered_orders") > 0)
        .select("customer_unique_id")
        .join(first_orders.select("customer_unique_id"), "customer_unique_id", "left_anti")
    )


def _outcome(name: Column, severity: str, threshold: int, violations: Column) -> list[Column]:
    bad = "fail" if severity == "error" else "warn"
    return [
        name.alias("name"),
        F.lit(severity).alias("severity"),
        F.lit(threshold).cast("long").alias("threshold"),
        violations.cast("long").alias("violations"),
        F.when(violations > threshold, F.lit(bad)).otherwise(F.lit("pass")).alias("status"),
    ]


@dataclass(frozen=True)
class Expectation:
    """A query for violations, tolerated up to ``threshold``.

    ``weight`` names the column that tells for how many violations a row stands (default: one).
    """

    name: str
    violations: DataFrame
    severity: str = "error"
    threshold: int = 0
    weight: str | None = None

    def outcomes(self) -> DataFrame:
        total = F.count(F.lit(1)) if self.weight is None else F.coalesce(F.sum(self.weight), F.lit(0))
        return self.violations.agg(total.alias("_n")).select(
            *_outcome(F.lit(self.name), self.severity, self.threshold, F.col("_n"))
        )


@dataclass(frozen=True)
class FilledColumns:
    """``not_null`` for several columns of one table, all in one scan."""

    table: str
    df: DataFrame
    columns: tuple[str, ...]

    def outcomes(self) -> DataFrame:
        counted = self.df.agg(*[F.count_if(F.col(column).isNull()).alias(column) for column in self.columns])
        entries = [
            F.struct(F.lit(f"not_null_{self.table}_{column}").alias("_name"), F.col(column).alias("_n"))
            for column in self.columns
        ]
        return counted.select(F.inline(F.array(*entries))).select(*_outcome(F.col("_name"), "error", 0, F.col("_n")))


@dataclass(frozen=True)
class Check:
    """A declared check of one relation, as rows that are tagged with it.

    ``kind`` says what a violation is: ``unique`` a key with several rows, ``accepted`` a value that occurs at all, ``orphan``
    each row without a parent, ``rows`` each row. ``where`` chooses the rows; ``parent`` is the relation and column of the
    keys there are.
    """

    name: str
    relation: str
    kind: str
    columns: tuple[str, ...] = ()
    where: Column | None = None
    parent: tuple[str, str] | None = None
    severity: str = "error"
    threshold: int = 0


def _violations(kind: str) -> Column:
    """How many violations a key of a check stands for."""
    return {
        "unique": F.when(F.col("_rows") > 1, 1),
        "accepted": F.lit(1),
        "orphan": F.when(~F.col("_known"), F.col("_rows")),
        "rows": F.col("_rows"),
    }[kind]


def _key(columns: Sequence[str]) -> Column:
    """The columns as one text: itself for one column, else each with its length in front, so different keys stay different."""
    texts = [F.col(c).cast("string") for c in columns]
    if len(texts) < 2:
        return texts[0] if texts else F.lit(None).cast("string")
    return F.concat(*[F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")) for text in texts])


def _tag(number: int, columns: Sequence[str], where: Column, known: bool = False) -> Column:
    """The tagged row of a check, null where the check is not about the row; keys are compared as text."""
    tagged = F.struct(F.lit(number).alias("_check"), _key(columns).alias("_key"), F.lit(known).alias("_known"))
    return F.when(where, tagged)


@dataclass(frozen=True)
class TableChecks:
    """All checks of a set of relations together: every relation is read once, and all keys meet in one aggregation.

    A row gives a tagged key for each check it takes part in. Keys are counted per check with map-side combine; a foreign
    key and the keys of its parent have the same tag, so an orphan is a key that no parent row has named. A check without
    any tagged row is reported with no violations.

    ``dealt`` names relations whose rows lie together by a column: their unique keys with that column are counted where they
    lie, in a reading of their own.
    """

    tables: Mapping[str, DataFrame]
    checks: Sequence[Check]
    dealt: Mapping[str, str] = field(default_factory=dict)

    def _in_place(self, check: Check) -> bool:
        return check.kind == "unique" and check.parent is None and self.dealt.get(check.relation) in check.columns

    def tagged(self) -> DataFrame:
        per_relation: dict[str, list[Column]] = {}
        for number, check in enumerate(self.checks):
            if self._in_place(check):
                continue
            rows = check.where if check.where is not None else F.lit(True)
            per_relation.setdefault(check.relation, []).append(_tag(number, check.columns, rows))
            if check.parent:
                relation, key = check.parent
                per_relation.setdefault(relation, []).append(_tag(number, [key], F.col(key).isNotNull(), known=True))
        tagged = None
        for relation, entries in per_relation.items():
            rows = self.tables[relation].select(F.inline(F.array_compact(F.array(*entries))))
            tagged = rows if tagged is None else tagged.unionByName(rows)
        return tagged

    def outcomes(self) -> DataFrame:
        counted = self.tagged().groupBy("_check", "_key").agg(
            F.count_if(~F.col("_known")).alias("_rows"), F.bool_or("_known").alias("_known")
        )
        violations = F.lit(0)
        for kind in {check.kind for check in self.checks}:
            numbers = [number for number, check in enumerate(self.checks) if check.kind == kind]
            violations = F.when(F.col("_check").isin(numbers), _violations(kind)).otherwise(violations)
        per_check = counted.groupBy("_check").agg(F.sum(violations).alias("_n"))
        for number, check in enumerate(self.checks):
            if self._in_place(check):
                rows = self.tables[check.relation]
                repeated = unique_combination(rows if check.where is None else rows.where(check.where), check.columns)
                found = repeated.agg(F.count(F.lit(1)).alias("_n")).select(F.lit(number).alias("_check"), "_n")
                per_check = per_check.unionByName(found)
        declared = per_check.sparkSession.createDataFrame(
            [(number, check.name, check.severity, check.threshold) for number, check in enumerate(self.checks)],
            "_check int, name string, severity string, threshold long",
        )
        n = F.coalesce("_n", F.lit(0)).cast("long")
        bad = F.when(F.col("severity") == "error", "fail").otherwise("warn")
        # At most one row per declared check on either side.
        return declared.join(F.broadcast(per_check), "_check", "left").select(
            "name", "severity", "threshold", n.alias("violations"), F.when(n > F.col("threshold"), bad).otherwise("pass").alias("status")
        )


def expectation_report(expectations: Sequence[Expectation | FilledColumns | TableChecks]) -> DataFrame:
    """One row per expectation: name, severity, threshold, violations, status."""
    report = expectations[0].outcomes()
    for expectation in expectations[1:]:
        report = report.unionByName(expectation.outcomes())
    return report


# The declared checks, (table, column) pairs and (child, foreign key, parent, key).
UNIQUE_COLUMNS = [
    ("stg_orders", "order_id"),
    ("stg_order_reviews", "order_id"),
    ("stg_customers", "customer_id"),
    ("stg_sellers", "seller_id"),
    ("stg_products", "product_id"),
    ("fct_orders", "order_id"),
    ("dim_customers", "customer_unique_id"),
    ("dim_sellers", "seller_id"),
    ("dim_products", "product_id"),
    ("mart_first_orders", "customer_unique_id"),
    ("mart_seller_delivery", "seller_id"),
    ("mart_monthly", "month"),
]
FILLED_COLUMNS = [
    *UNIQUE_COLUMNS,
    ("stg_orders", "customer_id"),
    ("stg_customers", "customer_unique_id"),
    ("fct_orders", "customer_unique_id"),
]
FOREIGN_KEYS = [
    ("stg_orders", "customer_id", "stg_customers", "customer_id"),
    ("stg_order_items", "order_id", "stg_orders", "order_id"),
    ("stg_order_items", "product_id", "stg_products", "product_id"),
    ("stg_order_items", "seller_id", "stg_sellers", "seller_id"),
    ("fct_orders", "customer_unique_id", "dim_customers", "customer_unique_id"),
    ("fct_order_items", "product_id", "dim_products", "product_id"),
]


def study_checks(
    impossible_dates_allowed: int = KNOWN_IMPOSSIBLE_DATES, payment_mismatches_allowed: int = KNOWN_PAYMENT_MISMATCHES
) -> list[Check]:
    """The 40 declared checks over staging tables and marts, by relation name."""

    def filled(column: str) -> Column:
        return F.col(column).isNotNull()

    def outside(column: str, values: Sequence) -> Column:
        return filled(column) & ~F.col(column).isin(list(values))

    checks = [Check(f"unique_{t}_{c}", t, "unique", (c,), filled(c)) for t, c in UNIQUE_COLUMNS]
    checks += [Check(f"not_null_{t}_{c}", t, "rows", where=F.col(c).isNull()) for t, c in FILLED_COLUMNS]
    checks += [
        Check(f"relationships_{t}_{c}", t, "orphan", (c,), filled(c), (parent, key)) for t, c, parent, key in FOREIGN_KEYS
    ]
    item_key = ("order_id", "order_item_id")
    buyers = F.col("delivered_orders") > 0
    return checks + [
        Check("unique_combination_stg_order_items_order_id_order_item_id", "stg_order_items", "unique", item_key),
        Check(
            "accepted_values_stg_orders_order_status",
            "stg_orders",
            "accepted",
            ("order_status",),
            outside("order_status", ORDER_STATUSES),
        ),
        Check(
            "accepted_values_stg_order_reviews_review_score",
            "stg_order_reviews",
            "accepted",
            ("review_score",),
            outside("review_score", REVIEW_SCORES),
        ),
        Check("delivery_after_purchase", "fct_orders", "rows", where=_delivered_before_purchase()),
        Check(
            "first_orders_cover_buyers",
            "dim_customers",
            "orphan",
            ("customer_unique_id",),
            buyers,
            ("mart_first_orders", "customer_unique_id"),
        ),
        Check(
            "known_impossible_dates",
            "stg_orders",
            "rows",
            where=_impossible_dates(),
            severity="warn",
            threshold=impossible_dates_allowed,
        ),
        Check(
            "payments_match_items",
            "fct_orders",
            "rows",
            where=_payment_off(PAYMENT_TOLERANCE),
            severity="warn",
            threshold=payment_mismatches_allowed,
        ),
    ]


def study_expectations(
    tables: Mapping[str, DataFrame],
    impossible_dates_allowed: int = KNOWN_IMPOSSIBLE_DATES,
    payment_mismatches_allowed: int = KNOWN_PAYMENT_MISMATCHES,
    dealt: Mapping[str, str] | None = None,
) -> list[TableChecks]:
    """The declared checks over the relations, which are read once each, but for unique keys of ``dealt`` ones."""
    return [TableChecks(tables, study_checks(impossible_dates_allowed, payment_mismatches_allowed), dealt or {})]


def one_row(spark: SparkSession, **values: DataFrame) -> DataFrame:
    """One row of scalar subqueries, one column for each single-value DataFrame."""
    return spark.range(1).select(*[value.scalar().alias(name) for name, value in values.items()])


def pitfall_counts(
    orders: DataFrame,
    customers: DataFrame,
    raw_reviews: DataFrame,
    paid_orders: DataFrame,
    monthly: DataFrame,
    tolerance: float = PAYMENT_TOLERANCE,
) -> DataFrame:
    """One row with the traps of the data. Review duplicates are counted before deduplication."""

    def count(df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)))

    dates = orders.agg(
        F.struct(
            F.count(F.lit(1)).alias("orders"),
            F.count_if(F.col("shipped_at") < F.col("purchased_at")).alias("early_shipped"),
            F.count_if(F.col("delivered_at") < F.col("shipped_at")).alias("early_delivered"),
        )
    )
    return one_row(
        orders.sparkSession,
        _dates=dates,
        customer_ids=customers.agg(F.count_distinct("customer_id")),
        unique_customers=customers.agg(F.count_distinct("customer_unique_id")),
        orders_with_several_reviews=count(unique_combination(raw_reviews, ["order_id"])),
        reviews_on_several_orders=count(unique_combination(raw_reviews, ["review_id"])),
        payment_mismatch=count(payments_match_items(paid_orders, tolerance)),
        partial_months=count(monthly.where("is_partial")),
    ).select(
        F.col("_dates.orders").alias("orders"),
        "customer_ids",
        "unique_customers",
        "orders_with_several_reviews",
        "reviews_on_several_orders",
        F.col("_dates.early_shipped").alias("shipped_before_purchase"),
        F.col("_dates.early_delivered").alias("delivered_before_shipped"),
        "payment_mismatch",
        "partial_months",
    )
