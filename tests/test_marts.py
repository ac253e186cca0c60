import datetime as dt
import statistics
from decimal import Decimal

from helpers import rows
from parcelwise.plans import marts

ROUTES = (
    "order_status string, delivered_at timestamp_ntz, seller_state string, customer_state string, promised_days bigint, "
    "actual_days bigint, is_late boolean, review_score int"
)


def test_route_mart_cuts_small_routes_and_matches_plain_statistics(frame):
    big = [
        ("delivered", "2018-01-01", "SP", "RJ", 10 + i % 4, i % 13, i % 13 > 9, None if i % 5 == 0 else 1 + i % 5)
        for i in range(30)
    ]
    small = [("delivered", "2018-01-01", "SP", "MG", 10, 5, False, 5)] * 29
    out = [("canceled", "2018-01-01", "SP", "RJ", 99, 99, True, 1), ("delivered", None, "SP", "RJ", 99, None, None, 1)]
    unplaced = [("delivered", "2018-01-01", None, "RJ", 99, 99, True, 1)]
    found = marts.mart_delivery_promise(frame(ROUTES, *big, *small, *out, *unplaced)).collect()
    assert [(r["seller_state"], r["customer_state"], r["orders"]) for r in found] == [("SP", "RJ", 30)]
    route = found[0]
    actual = sorted(row[5] for row in big)
    assert route["median_promised_days"] == statistics.median(row[4] for row in big)
    assert route["median_actual_days"] == statistics.median(actual)
    low, share = divmod(0.9 * 29, 1)
    assert abs(route["p90_actual_days"] - (actual[int(low)] + share * (actual[int(low) + 1] - actual[int(low)]))) < 1e-6
    scored = [row for row in big if row[7] is not None]
    assert route["bad_review_rate"] == sum(row[7] <= 2 for row in scored) / len(scored)
    assert route["late_rate"] == sum(row[6] for row in big) / 30
    assert route["bad_reviews_late"] == sum(row[6] and row[7] <= 2 for row in scored)


def test_late_bad_reviews_are_null_when_nothing_is_known(frame):
    late_unscored = [("delivered", "2018-01-01", "SP", "RJ", 1, 2, True, None)] * 2
    found = marts.mart_delivery_promise(frame(ROUTES, *late_unscored), min_orders=1).first()
    assert found["bad_reviews_late"] is None and found["bad_review_rate"] is None
    on_time = [("delivered", "2018-01-01", "SP", "RJ", 2, 1, False, None)]
    found = marts.mart_delivery_promise(frame(ROUTES, *late_unscored, *on_time), min_orders=1).first()
    assert found["bad_reviews_late"] == 0


def test_first_orders_bounds_are_inclusive_times(frame):
    orders = frame(
        "customer_unique_id string, order_id string, order_status string, purchased_at timestamp_ntz, customer_state string, "
        "is_late boolean",
        ("in", "a1", "delivered", "2018-01-01 10:00:00", "SP", False),
        ("in", "a2", "delivered", "2018-06-30 10:00:00", "SP", False),
        ("in", "a3", "delivered", "2018-07-30 10:00:00", "SP", False),
        ("out", "b1", "delivered", "2018-01-01 10:00:00", "SP", True),
        ("out", "b2", "delivered", "2018-06-30 10:00:01", "SP", True),
        ("cut", "c1", "delivered", "2018-03-02 00:00:00", "SP", None),
        ("after", "d1", "delivered", "2018-03-02 00:00:01", "SP", None),
        ("late_first", "e0", "canceled", "2017-01-01 00:00:00", "SP", None),
        ("late_first", "e1", "delivered", "2017-05-01 00:00:00", "SP", None),
    )
    found = {r["customer_unique_id"]: r for r in marts.mart_first_orders(orders, dt.date(2018, 8, 29)).collect()}
    assert found["in"]["order_id"] == "a1" and found["in"]["returned_in_window"] is True
    assert found["in"]["next_purchased_at"] == dt.datetime(2018, 6, 30, 10)
    assert found["out"]["returned_in_window"] is False
    assert found["cut"]["is_eligible"] is True and found["cut"]["returned_in_window"] is False
    assert found["after"]["is_eligible"] is False
    assert found["late_first"]["order_id"] == "e1"


def test_first_orders_limit_rows_per_person_in_the_map_tasks(frame):
    orders = frame(
        "customer_unique_id string, order_id string, order_status string, purchased_at timestamp_ntz",
        ("u", "a", "delivered", "2018-01-01"),
    )
    plan = marts.mart_first_orders(orders, dt.date(2018, 8, 29))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_monthly_uses_date_for_lateness_and_all_scores(frame):
    schema = (
        "order_id string, customer_unique_id string, order_status string, purchased_at timestamp_ntz, "
        "delivered_at timestamp_ntz, is_late boolean, items_value decimal(20,2), review_score int"
    )
    orders = frame(
        schema,
        ("a", "u1", "delivered", "2018-01-31 23:59:59", "2018-02-10", False, Decimal("10.00"), 5),
        ("b", "u1", "delivered", "2018-01-15 00:00:00", "2018-02-10", False, Decimal("20.00"), None),
        # Canceled with a delivery date: in the late rate and the mean score, not among the delivered.
        ("c", "u2", "canceled", "2018-01-20 00:00:00", "2018-02-10", True, Decimal("99.00"), 1),
        ("d", "u3", "delivered", "2018-02-01 00:00:00", None, None, None, 3),
    )
    found = {r["month"]: r.asDict() for r in marts.mart_monthly(orders, orders, min_orders=2).collect()}
    january, february = found[dt.date(2018, 1, 1)], found[dt.date(2018, 2, 1)]
    assert (january["orders"], january["delivered_orders"], january["gmv"]) == (3, 2, Decimal("30.00"))
    assert january["avg_basket"] == 15.0 and january["avg_review"] == 3.0
    assert abs(january["late_rate"] - 1 / 3) < 1e-12
    assert (january["new_customers"], january["is_partial"]) == (1, False)
    assert (february["new_customers"], february["is_partial"], february["gmv"], february["late_rate"]) == (1, True, None, None)


def test_seller_mart_counts_two_seller_orders_twice(frame):
    items = frame("order_id string, seller_id string", ("o1", "s1"), ("o1", "s1"), ("o1", "s2"), ("o2", "s1"), ("o3", "s1"))
    orders = frame(
        "order_id string, order_status string, delivered_at timestamp_ntz, is_late boolean, review_score int",
        ("o1", "delivered", "2018-01-01", True, 1),
        ("o2", "delivered", "2018-01-01", False, None),
        ("o3", "shipped", None, None, 1),
    )
    sellers = frame("seller_id string, state string", ("s1", "SP"), ("s2", "RJ"))
    assert sorted(rows(marts.mart_seller_delivery(items, orders, sellers))) == [
        ("s1", "SP", 2, 1, 0.5, 1.0, 1),
        ("s2", "RJ", 1, 1, 1.0, 1.0, 1),
    ]
