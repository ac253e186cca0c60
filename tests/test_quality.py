from decimal import Decimal

from helpers import one, rows
from parcelwise.plans import quality
from parcelwise.plans.quality import Expectation, FilledColumns


def test_unique_ignores_nulls_and_counts_values(frame):
    df = frame("k string, v int", ("a", 1), ("a", 2), ("a", 3), ("b", 1), (None, 1), (None, 2))
    assert rows(quality.unique(df, "k")) == [("a", 3)]
    assert sorted(rows(quality.unique_combination(df, ["k", "v"]))) == []
    assert sorted(rows(quality.unique_combination(df.select("v"), ["v"]))) == [(1, 3), (2, 2)]
    assert quality.not_null(df, "k").count() == 2


def test_accepted_values_let_nulls_pass(frame):
    df = frame("status string", ("delivered",), ("lost",), ("lost",), (None,))
    assert rows(quality.accepted_values(df, "status", quality.ORDER_STATUSES)) == [("lost", 2)]


def test_relationships_count_child_rows_per_key(frame):
    child = frame("fk string", ("a",), ("b",), ("b",), (None,))
    parent = frame("pk string", ("a",), ("c",))
    orphans = quality.relationships(child, "fk", parent, "pk")
    assert rows(orphans) == [("b", 2)]
    assert one(Expectation("x", orphans, weight="n_rows").outcomes())["violations"] == 2
    same_table = quality.relationships(parent, "pk", parent, "pk")
    assert rows(same_table) == []


def test_date_faults_are_counted_as_a_union(frame):
    orders = frame(
        "order_id string, purchased_at timestamp_ntz, shipped_at timestamp_ntz, delivered_at timestamp_ntz",
        ("both", "2018-01-05", "2018-01-04", "2018-01-03"),
        ("shipped", "2018-01-05", "2018-01-04", "2018-01-06"),
        ("fine", "2018-01-05", "2018-01-05", "2018-01-05"),
        ("open", "2018-01-05", None, None),
    )
    assert sorted(rows(quality.known_impossible_dates(orders))) == [("both",), ("shipped",)]
    assert rows(quality.delivery_after_purchase(orders)) == [("both",)]


def test_payment_tolerance_is_strict_and_exact(frame):
    orders = frame(
        "order_id string, items_value decimal(20,2), freight_value decimal(20,2), payment_value decimal(20,2)",
        ("5 cents", Decimal("10.00"), Decimal("1.00"), Decimal("11.05")),
        ("6 cents", Decimal("10.00"), Decimal("1.00"), Decimal("10.94")),
        ("unpaid", Decimal("10.00"), Decimal("1.00"), None),
        ("no items", None, None, Decimal("1.00")),
    )
    assert rows(quality.payments_match_items(orders)) == [("6 cents", Decimal("11.00"), Decimal("10.94"))]


def test_buyers_without_first_order(frame):
    people = frame("customer_unique_id string, delivered_orders bigint", ("a", 1), ("b", 2), ("c", 0))
    firsts = frame("customer_unique_id string", ("a",))
    assert rows(quality.first_orders_cover_buyers(people, firsts)) == [("b",)]


def test_report_severity_and_threshold(spark, frame):
    checks = [
        Expectation("at", spark.range(189), "warn", 189),
        Expectation("above", spark.range(190), "warn", 189),
        Expectation("error", spark.range(1)),
        Expectation("clean", spark.range(0)),
        FilledColumns("t", frame("a string, b string", ("x", None), ("y", None)), ("a", "b")),
    ]
    found = {name: (severity, n, status) for name, severity, _, n, status in rows(quality.expectation_report(checks))}
    assert found == {
        "at": ("warn", 189, "pass"),
        "above": ("warn", 190, "warn"),
        "error": ("error", 1, "fail"),
        "clean": ("error", 0, "pass"),
        "not_null_t_a": ("error", 0, "pass"),
        "not_null_t_b": ("error", 2, "fail"),
    }


def test_pitfalls(frame):
    orders = frame(
        "order_id string, purchased_at timestamp_ntz, shipped_at timestamp_ntz, delivered_at timestamp_ntz",
        ("a", "2018-01-05", "2018-01-04", "2018-01-03"),
        ("b", "2018-01-05", "2018-01-06", "2018-01-07"),
    )
    customers = frame("customer_id string, customer_unique_id string", ("c1", "u"), ("c2", "u"))
    reviews = frame("review_id string, order_id string", ("r1", "a"), ("r2", "a"), ("r1", "b"))
    paid = frame(
        "order_id string, items_value decimal(20,2), freight_value decimal(20,2), payment_value decimal(20,2)",
        ("a", Decimal("1.00"), Decimal("0.00"), Decimal("2.00")),
    )
    months = frame("month date, is_partial boolean", ("2018-01-01", True), ("2018-02-01", False))
    assert one(quality.pitfall_counts(orders, customers, reviews, paid, months)) == {
        "orders": 2,
        "customer_ids": 2,
        "unique_customers": 1,
        "orders_with_several_reviews": 1,
        "reviews_on_several_orders": 1,
        "shipped_before_purchase": 1,
        "delivered_before_shipped": 1,
        "payment_mismatch": 1,
        "partial_months": 1,
    }


def test_a_fan_out_in_the_published_fact_is_found(spark):
    from workload import params as p
    from workload.study import BuiltStudy
    from workload.queries import checked_tables

    tables = checked_tables(BuiltStudy(spark, "/root/testdata/sf0.001"))
    fact = tables["fct_orders"]
    assert {"order_rank", "is_first_order"} <= set(fact.columns)
    tables["fct_orders"] = fact.unionByName(fact.where("order_rank = 2").limit(3))
    found = quality.expectation_report(quality.study_expectations(tables, p.IMPOSSIBLE_ALLOWED, p.MISMATCH_ALLOWED))
    failed = {r["name"]: r["violations"] for r in found.where("status = 'fail'").collect()}
    assert failed["unique_fct_orders_order_id"] == 3


def test_report_reads_each_relation_once(spark, tmp_path):
    from workload.study import Study
    from workload.queries import checked_tables

    tables = {}
    for name, df in checked_tables(Study(spark, "/root/testdata/sf0.001")).items():
        df.write.parquet(f"{tmp_path}/{name}")
        tables[name] = spark.read.parquet(f"{tmp_path}/{name}")
    report = quality.expectation_report(quality.study_expectations(tables))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == len(tables)
    assert report.count() == 40


def test_tagged_checks_count_what_the_single_checks_find(frame):
    child = frame("id string, fk string, n int", ("a", "x", 1), ("a", "y", 9), (None, "y", 3), (None, None, None), ("c", "z", 9))
    parent = frame("pk string", ("x",), ("x",), (None,))
    checks = [
        quality.Check("unique", "child", "unique", ("id",), quality.F.col("id").isNotNull()),
        quality.Check("pairs", "child", "unique", ("id", "fk")),
        quality.Check("nulls", "child", "rows", where=quality.F.col("n").isNull(), severity="warn", threshold=1),
        quality.Check("links", "child", "orphan", ("fk",), quality.F.col("fk").isNotNull(), ("parent", "pk")),
        quality.Check("values", "child", "accepted", ("n",), quality.F.col("n") > 2),
        quality.Check("parents", "parent", "unique", ("pk",), quality.F.col("pk").isNotNull()),
        quality.Check("nothing", "parent", "rows", where=quality.F.lit(False)),
    ]
    report = quality.expectation_report([quality.TableChecks({"child": child, "parent": parent}, checks)])
    assert {r["name"]: (r["violations"], r["status"]) for r in report.collect()} == {
        "unique": (1, "fail"),
        "pairs": (0, "pass"),
        "nulls": (1, "pass"),
        "links": (3, "fail"),
        "values": (2, "fail"),
        "parents": (1, "fail"),
        "nothing": (0, "pass"),
    }
