import datetime as dt
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from helpers import one, rows
from parcelwise.plans import delivery, promise, rolling, routes

SCHEMA = (
    "order_id string, order_status string, purchased_at timestamp_ntz, delivered_at timestamp_ntz, seller_state string, "
    "customer_state string, promised_days bigint, actual_days bigint, is_late boolean, review_score int"
)
CUTOFF = dt.date(2018, 1, 1)


def make_orders():
    rng = random.Random(11)
    orders = []
    for i in range(3000):
        bought = dt.datetime(2017, 6, 1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 365))
        seller, customer = rng.choice(["SP", "SP", "SP", "RJ", None]), rng.choice(["SP", "RJ", "BA"])
        slow = 6 if (seller, customer) == ("SP", "BA") else 0
        actual, promised = int(rng.gammavariate(3, 4)) + slow, rng.randrange(8, 30)
        score = rng.choice([None, 1, 2, 3, 4, 5])
        orders.append((str(i), "delivered", bought, bought + dt.timedelta(days=actual), seller, customer, promised, actual, actual > promised, score))
    # A route only the holdout knows.
    late = dt.datetime(2018, 3, 1)
    orders += [(f"x{i}", "delivered", late, late + dt.timedelta(days=9), "XX", "SP", 8, 9, True, 1) for i in range(5)]
    # Exactly at the cutoff: holdout.
    cut = dt.datetime(2018, 1, 1)
    orders.append(("cut", "delivered", cut, cut + dt.timedelta(days=3), "SP", "SP", 9, 3, False, 5))
    return orders


ORDERS = make_orders()
BEFORE = [o for o in ORDERS if o[2] < dt.datetime(2018, 1, 1)]
HOLDOUT = [o for o in ORDERS if o[2] >= dt.datetime(2018, 1, 1) and o[4] is not None]


def bucket(days):
    for high, label in ((7, "0-7"), (14, "8-14"), (21, "15-21"), (30, "22-30")):
        if days <= high:
            return label
    return "31+"


def plain_rates():
    seen = defaultdict(list)
    for o in BEFORE:
        if o[9] is not None:
            seen[bucket(o[7]), o[8]].append(o[9] <= 2)
    return {key: sum(flags) / len(flags) for key, flags in seen.items()}


def plain_routes():
    seen = defaultdict(list)
    for o in BEFORE:
        if o[4] is not None:
            seen[o[4], o[5]].append(o)
    return {
        route: (len(os), sum(o[8] for o in os) / len(os), float(np.quantile([o[7] for o in os], 0.93)))
        for route, os in seen.items()
    }


@pytest.fixture(scope="module")
def delivered(frame):
    return delivery.with_delay_bucket(frame(SCHEMA, *ORDERS))


@pytest.fixture(scope="module")
def backtest(delivered):
    cells = promise.promise_cells(delivered, CUTOFF).cache()
    return (
        promise.holdout_cells(cells),
        promise.calibrate_routes(cells),
        promise.global_quantile(cells),
        promise.bad_rate_table(cells),
    )


def test_holdout_starts_at_the_cutoff_and_has_one_seller(delivered):
    assert {i for (i,) in rows(promise.holdout(delivered, CUTOFF), "order_id")} == {o[0] for o in HOLDOUT}


def test_calibration(backtest):
    found = {(r["seller_state"], r["customer_state"]): r for r in backtest[1].collect()}
    expected = plain_routes()
    assert set(found) == set(expected)
    for route, (n, late, q) in expected.items():
        assert found[route]["n"] == n and abs(found[route]["late_rate"] - late) < 1e-12
        assert abs(found[route]["q"] - q) < 1e-6
    # The global quantile also covers orders with several sellers.
    assert abs(one(backtest[2])["global_q"] - np.quantile([o[7] for o in BEFORE], 0.93)) < 1e-6


def test_bad_rates(backtest):
    found = {(b, late): rate for b, late, rate in rows(backtest[3], "bucket", "is_late", "bad_rate")}
    expected = plain_rates()
    assert set(found) == set(expected)
    assert all(abs(found[key] - expected[key]) < 1e-12 for key in expected)


def plain_policy(new_promise):
    """Row by row over the holdout."""
    rates, calibrated = plain_rates(), plain_routes()
    promises = [new_promise(o, calibrated.get((o[4], o[5]))) for o in HOLDOUT]
    late = [o[7] > q for o, q in zip(HOLDOUT, promises)]
    reviewed = [o[9] is not None for o in HOLDOUT]

    def bad(flags):
        return sum(rates.get((bucket(o[7]), f), 0) for o, f, r in zip(HOLDOUT, flags, reviewed) if r)

    n = len(HOLDOUT)
    return {
        "orders": n,
        "old_promise": sum(o[6] for o in HOLDOUT) / n,
        "new_promise": sum(promises) / n,
        "old_late_rate": sum(o[8] for o in HOLDOUT) / n,
        "new_late_rate": sum(late) / n,
        "old_bad_reviews": bad([o[8] for o in HOLDOUT]),
        "new_bad_reviews": bad(late),
    }


def same(found, expected):
    assert found.keys() - {"policy"} == expected.keys()
    for name, value in expected.items():
        assert abs(found[name] - value) < 1e-5, name


RISKY = dict(min_orders=30, above=0.2)


def is_risky(route):
    return route is not None and route[0] >= 30 and route[1] > 0.2


def test_policies_equal_row_by_row_evaluation(backtest):
    overall = float(np.quantile([o[7] for o in BEFORE], 0.93))
    rules = {
        "quantile": promise.quantile_promise(200),
        "plus_5": promise.margin_promise(promise.is_risky(**RISKY), 5),
    }
    found = {r["policy"]: r.asDict() for r in promise.evaluate_policies(*backtest, rules).collect()}
    same(
        found["quantile"],
        plain_policy(lambda o, r: math.ceil(round(r[2] if r is not None and r[0] >= 200 else overall, 6))),
    )
    same(found["plus_5"], plain_policy(lambda o, r: o[6] + (5 if is_risky(r) else 0)))


def test_margin_grid_equals_row_by_row_evaluation_and_is_monotone(backtest):
    grid = [r.asDict() for r in promise.margin_grid(*backtest, promise.is_risky(**RISKY)).collect()]
    assert [g["margin"] for g in grid] == list(range(11))
    assert (grid[0]["extra_days"], grid[0]["late_avoided_share"]) == (0.0, 0.0)
    shares = [g["late_avoided_share"] for g in grid]
    assert shares == sorted(shares) and shares[-1] > 0
    for g in grid:
        plain = plain_policy(lambda o, r: o[6] + (g["margin"] if is_risky(r) else 0))
        assert abs(g["new_promise"] - plain["new_promise"]) < 1e-9
        assert abs(g["new_late_rate"] - plain["new_late_rate"]) < 1e-12
        assert abs(g["late_avoided_share"] - (1 - plain["new_late_rate"] / plain["old_late_rate"])) < 1e-9
        assert abs(g["new_bad_reviews"] - plain["new_bad_reviews"]) < 1e-5
    named = promise.evaluate_policy("plus", promise.margin_promise(promise.is_risky(**RISKY), 5), *backtest)
    assert one(named)["new_late_rate"] == grid[5]["new_late_rate"]


def test_rounded_margin_grid_follows_the_published_figures(backtest):
    grid = promise.margin_grid(*backtest, promise.is_risky(**RISKY), compat_rounding=True).collect()
    routes, late_before = plain_routes(), round(sum(o[8] for o in HOLDOUT) / len(HOLDOUT), 4)
    for g in grid:
        promises = [o[6] + (g["margin"] if is_risky(routes.get((o[4], o[5]))) else 0) for o in HOLDOUT]
        late = round(sum(o[7] > days for o, days in zip(HOLDOUT, promises)) / len(HOLDOUT), 4)
        assert g["new_promise"] == round(sum(promises) / len(promises), 2)
        assert g["new_late_rate"] == late and g["late_avoided_share"] == round(1 - late / late_before, 4)
        assert g["extra_days"] == round(g["new_promise"] - grid[0]["new_promise"], 2)
        assert g["new_bad_reviews"] == int(g["new_bad_reviews"])


def test_any_margin_is_a_place_in_the_counts(backtest):
    rule = promise.is_risky(**RISKY)
    grid = {g["margin"]: g.asDict() for g in promise.margin_grid(*backtest, rule, margins=[60, -3, 0, 7]).collect()}
    assert list(grid) == [-3, 0, 7, 60]
    for margin in (-3, 60):
        named = one(promise.evaluate_policy("m", promise.margin_promise(rule, margin), *backtest))
        for name in ("orders", "new_promise", "new_late_rate"):
            assert abs(grid[margin][name] - named[name]) < 1e-12
        assert abs(grid[margin]["new_bad_reviews"] - named["new_bad_reviews"]) < 1e-5


def test_margin_grid_reads_the_holdout_once(delivered):
    cells = promise.promise_cells(delivered, CUTOFF)
    fixed = cells.sparkSession.createDataFrame([("SP", "SP", 40, 0.5, 9.0)], "seller_state string, customer_state string, n bigint, late_rate double, q double")
    rates = cells.sparkSession.createDataFrame([("0-7", True, 0.5)], "bucket string, is_late boolean, bad_rate double")
    overall = cells.sparkSession.createDataFrame([(9.0,)], "global_q double")
    grid = promise.margin_grid(promise.holdout_cells(cells), fixed, overall, rates, promise.is_risky())
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 1
    assert plan.count("purchased_at") > 0 and plan.count("Union") == 0


def test_risky_routes(backtest):
    chosen = [r for r in plain_routes().values() if is_risky(r)]
    assert one(promise.risky_routes(backtest[1], promise.is_risky(**RISKY))) == {
        "routes": len(chosen),
        "calibration_orders": sum(r[0] for r in chosen),
    }


def window(day, state=None):
    return [
        o[7]
        for o in ORDERS
        if day - dt.timedelta(days=14) <= o[3].date() < day and (state is None or o[5] == state)
    ]


START, END = dt.date(2018, 1, 1), dt.date(2018, 4, 10)


@pytest.fixture(scope="module")
def rolling_tables(delivered):
    cells = rolling.delivery_cells(delivered).cache()
    return cells, rolling.rolling_quantile(cells, START, END, by=()), rolling.rolling_quantile(cells, START, END)


def test_rolling_quantile_equals_a_range_comparison(rolling_tables):
    _, whole, states = rolling_tables
    days = [START + dt.timedelta(days=i) for i in range((END - START).days)]
    expected = {day: window(day) for day in days if window(day)}
    found = {day: (q, n) for day, q, n in rows(whole, "day", "q", "n")}
    assert set(found) == set(expected)
    for day, delays in expected.items():
        assert found[day][1] == len(delays) and abs(found[day][0] - np.quantile(delays, 0.93)) < 1e-6
    by_state = {(day, state): (q, n) for day, state, q, n in rows(states, "day", "customer_state", "q", "n")}
    for day in days:
        for state in ("SP", "RJ", "BA"):
            delays = window(day, state)
            assert by_state.get((day, state), (None, 0))[1] == len(delays)


def test_rolling_window_edges(frame):
    schema = "purchased_at timestamp_ntz, delivered_at timestamp_ntz, customer_state string, actual_days bigint"
    orders = frame(schema, ("2018-01-01", "2018-01-10 23:59:59", "SP", 9))
    found = rows(rolling.rolling_quantile(rolling.delivery_cells(orders), dt.date(2018, 1, 1), dt.date(2018, 3, 1)), "day")
    assert sorted(d for (d,) in found) == [dt.date(2018, 1, 11) + dt.timedelta(days=i) for i in range(14)]


def test_rolling_quantile_has_no_range_join(rolling_tables):
    for df in rolling_tables[1:]:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rolling_policy_equals_row_by_row_evaluation(rolling_tables):
    found = one(rolling.evaluate_rolling_policy(*rolling_tables, CUTOFF, min_deliveries=20))
    promises, missing, march = [], 0, []
    for o in HOLDOUT:
        day = o[2].date()
        delays = window(day) if START <= day < END else []
        if not delays:
            missing += 1
            continue
        own = window(day, o[5])
        q = math.ceil(round(float(np.quantile(own if len(own) >= 20 else delays, 0.93)), 6))
        promises.append((q, o[7] > q))
        if day.month == 3:
            march.append(o[7] > q)
    assert missing > 0
    assert (found["orders"], found["orders_without_window"]) == (len(promises), missing)
    assert abs(found["new_promise"] - sum(q for q, _ in promises) / len(promises)) < 1e-9
    assert abs(found["new_late_rate"] - sum(late for _, late in promises) / len(promises)) < 1e-12
    assert abs(found["focus_late_rate"] - sum(march) / len(march)) < 1e-12


def test_route_table(frame):
    mart = frame(
        "seller_state string, customer_state string, orders bigint, median_promised_days double, median_actual_days double, "
        "p90_actual_days double, late_rate double, bad_review_rate double",
        ("SP", "RJ", 50, 20.0, 10.0, 15.0, 0.12, 0.1),
        ("RJ", "BA", 90, 20.0, 10.0, 15.0, 0.05, 0.1),
        ("BA", "BA", 50, 20.0, 10.0, 15.0, 0.2, 0.1),
    )
    assert rows(routes.route_table(mart), "route", "is_hot") == [
        ("RJ → BA", False),
        ("BA → BA", True),
        ("SP → RJ", True),
    ]
    assert rows(routes.route_table(mart, " ba "), "route") == [("RJ → BA",), ("BA → BA",)]
    assert rows(routes.route_table(mart, "", "late_rate", ascending=True), "route") == [("RJ → BA",), ("SP → RJ",), ("BA → BA",)]
    assert rows(routes.route_table(mart, "B")) == []
