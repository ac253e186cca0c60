import random
from collections import defaultdict

import pytest

from helpers import one, rows
from parcelwise.plans import sellers

TIMELINE = (
    "order_id string, order_status string, purchased_at timestamp_ntz, shipped_at timestamp_ntz, "
    "delivered_at timestamp_ntz, is_late boolean"
)


def test_handover_leaves_out_impossible_dates(frame):
    timeline = frame(
        TIMELINE,
        ("ok", "delivered", "2018-01-01 10:00:00", "2018-01-03 09:00:00", "2018-01-10 08:00:00", True),
        ("same", "delivered", "2018-01-01 10:00:00", "2018-01-01 10:00:00", "2018-01-01 10:00:00", False),
        ("early_ship", "delivered", "2018-01-02 10:00:00", "2018-01-01 10:00:00", "2018-01-05 10:00:00", False),
        ("early_arrival", "delivered", "2018-01-02 10:00:00", "2018-01-06 10:00:00", "2018-01-05 10:00:00", False),
        ("no_ship", "delivered", "2018-01-02 10:00:00", None, "2018-01-05 10:00:00", False),
        ("no_items", "delivered", "2018-01-01 10:00:00", "2018-01-03 09:00:00", "2018-01-10 08:00:00", True),
    )
    items = frame(
        "order_id string, shipping_limit_at timestamp_ntz",
        ("ok", "2018-01-02 00:00:00"),
        ("ok", "2018-01-03 08:59:59"),
        ("same", "2018-01-02 00:00:00"),
        ("early_ship", "2018-01-02 00:00:00"),
        ("early_arrival", "2018-01-02 00:00:00"),
    )
    found = sellers.handover(timeline, items)
    assert sorted(rows(found)) == [("ok", True, True, 2, 7), ("same", False, False, 0, 0)]
    summary = one(sellers.handover_summary(found))
    assert (summary["orders"], summary["seller_late_orders"], summary["late_with_seller_on_time"]) == (2, 1, 0)
    assert (summary["late_rate_if_seller_late"], summary["late_rate_if_seller_on_time"]) == (1.0, 0.0)
    assert (summary["carrier_days_late"], summary["carrier_days_on_time"]) == (7.0, 0.0)


@pytest.fixture(scope="module")
def market(frame):
    rng = random.Random(5)
    seller_states = {f"s{i}": rng.choice(["SP", "RJ", "MG"]) for i in range(25)}
    orders, items = [], []
    for i in range(600):
        late = rng.choice([True, False, False, None])
        orders.append((f"o{i}", "delivered", "2018-01-01", rng.choice(["SP", "BA"]), late, rng.choice([1, 5, None])))
        for _ in range(rng.choice([1, 1, 2, 3])):
            items.append((f"o{i}", f"s{int(25 * rng.random() ** 2)}"))
    items.append(("o0", "unknown seller"))
    schema = (
        "order_id string, order_status string, delivered_at timestamp_ntz, customer_state string, is_late boolean, review_score int"
    )
    frames = (
        frame("order_id string, seller_id string", *items),
        frame(schema, *orders),
        frame("seller_id string, state string", *seller_states.items()),
    )
    by_order = {o[0]: o for o in orders}
    pairs = [(by_order[o], s) for o, s in sorted(set(items)) if s in seller_states]
    return frames, pairs, seller_states


def test_order_sellers_are_distinct_pairs(market):
    frames, pairs, states = market
    expected = sorted((o[0], s, states[s], o[3], o[4], o[5]) for o, s in pairs)
    assert sorted(rows(sellers.order_sellers(*frames)), key=lambda r: r[:2]) == expected


def plain_excess(pairs, states):
    late_of, timed_of = defaultdict(int), defaultdict(int)
    for order, seller in pairs:
        if order[4] is not None:
            late_of[states[seller], order[3]] += order[4]
            timed_of[states[seller], order[3]] += 1
    found = defaultdict(lambda: [0, 0, 0.0])
    for order, seller in pairs:
        found[seller][0] += 1
        found[seller][1] += bool(order[4])
        found[seller][2] += late_of[states[seller], order[3]] / timed_of[states[seller], order[3]]
    return found


def test_excess_equals_row_by_row_computation(market):
    frames, pairs, states = market
    found = {r["seller_id"]: r for r in sellers.seller_excess(*frames).collect()}
    expected = plain_excess(pairs, states)
    assert set(found) == set(expected)
    for seller, (orders, late, should) in expected.items():
        assert (found[seller]["orders"], found[seller]["late"]) == (orders, late)
        assert abs(found[seller]["expected"] - should) < 1e-9


@pytest.mark.parametrize("share", [0.1, 0.5, 0.97, 1.0])
@pytest.mark.parametrize("slices", [2, 7, 40])
def test_concentration_equals_a_plain_running_sum(market, share, slices):
    frames, pairs, states = market
    found = one(sellers.seller_concentration(sellers.seller_excess(*frames), share, slices))
    ordered = sorted(plain_excess(pairs, states).items(), key=lambda e: (-e[1][1], e[0]))
    total_late, total_orders = sum(e[1][1] for e in ordered), sum(e[1][0] for e in ordered)
    late = orders = 0
    for rank, (_, (n, bad, _)) in enumerate(ordered, 1):
        late, orders = late + bad, orders + n
        if late >= share * total_late:
            break
    assert found == {
        "sellers": len(ordered),
        "late_orders": total_late,
        "sellers_for_share": rank,
        "order_share": orders / total_orders,
    }


def test_flags_need_all_three_conditions(frame):
    excess = frame(
        "seller_id string, orders bigint, late bigint, expected double",
        ("yes", 30, 15, 9.0),
        ("few", 29, 15, 9.0),
        ("exact_ratio", 40, 15, 10.0),
        ("small", 40, 6, 1.5),
        ("exact_excess", 40, 10, 5.0),
    )
    flagged = sellers.flag_excess_sellers(excess)
    assert sorted(rows(flagged, "seller_id", "excess")) == [("exact_excess", 5.0), ("yes", 6.0)]
    assert one(sellers.excess_summary(flagged)) == {"excess_sellers": 2, "excess_late": 11.0}
    nobody = sellers.flag_excess_sellers(excess, min_orders=1000)
    assert one(sellers.excess_summary(nobody)) == {"excess_sellers": 0, "excess_late": None}
