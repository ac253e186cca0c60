import pytest

from helpers import rows
from parcelwise import session, shaping
from parcelwise.plans import model, quality, staging
from workload import queries
from workload.study import BuiltStudy, Study

FOLDER = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def catalog(spark):
    return {table.name for table in spark.catalog.listTables()}


def test_dealt_orders_and_lines_move_once(spark):
    plain, before = Study(spark, FOLDER), catalog(spark)
    with session.scope(spark), shaping.dealt(plain.source) as dealt:
        study = BuiltStudy(spark, FOLDER, dealt)
        by_order = {
            "items": model.order_item_rollup(study.items),
            "payments": model.order_payment_rollup(study.payments),
            "reviews": staging.latest_review_per_order(study.all_reviews),
            "pairs": study.items.select("order_id", "seller_id").distinct(),
            "limits": study.items_with_limit,
            "reviewed": study.orders.join(study.reviews, "order_id", "left"),
        }
        assert {name: exchanges(df) for name, df in by_order.items()} == dict.fromkeys(by_order, 0)
        assert exchanges(model.order_item_rollup(plain.items)) == 2
        assert rows(by_order["limits"].orderBy(*by_order["limits"].columns)) == rows(
            plain.items_with_limit.orderBy(*by_order["limits"].columns)
        )
        inside = catalog(spark)
    assert len(inside - before) == 4 and catalog(spark) == before


def test_results_in_scope_read_lines_from_buckets(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(shaping, "forget_bucketed", lambda spark, folder, names: seen.extend(names))
    plain = Study(spark, FOLDER)
    found = dict(rows(queries.results_in_scope(plain)))
    assert {"lineitem", "orders", "written_orders", "written_reviews", "written_paid_fact"} == set(seen)
    apart = queries.expectation_report(BuiltStudy(spark, FOLDER)).groupBy("status").count()
    assert {f"checks {status}": n for status, n in rows(apart)} == {k: n for k, n in found.items() if (k or "").startswith("checks")}
    session.remove_written(spark)


@pytest.mark.parametrize("dealt", [{}, {"t": "a"}])
def test_unique_keys_counted_in_place_or_together(frame, dealt):
    t = frame(
        "a string, b string",
        ("1", "23"), ("12", "3"), ("1:2", "3"), ("1", "2:3"), (None, "x"), (None, "x"), ("-", "x"), ("null", "x"), ("p", "q"), ("p", "q"), ("p", "q"), (None, None),
    )
    checks = [
        quality.Check("both", "t", "unique", ("a", "b")),
        quality.Check("one", "t", "unique", ("a",), t["a"].isNotNull()),
        quality.Check("other", "t", "unique", ("b",), t["b"].isNotNull()),
    ]
    report = quality.expectation_report([quality.TableChecks({"t": t}, checks, dealt)])
    assert sorted(rows(report, "name", "violations")) == [("both", 2), ("one", 2), ("other", 3)]
