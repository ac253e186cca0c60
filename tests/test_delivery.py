import datetime as dt

from helpers import one, rows
from parcelwise.plans import delivery

SCHEMA = (
    "order_id string, order_status string, purchased_at timestamp_ntz, delivered_at timestamp_ntz, promised_days bigint, "
    "actual_days bigint, is_late boolean, review_score int, has_review_text boolean, reviewed_before_delivery boolean"
)


def order(i, actual=5, late=False, score=5, purchased="2018-01-05 10:00:00", status="delivered", text=False, before=False):
    return (str(i), status, purchased, "2018-02-01" if status == "delivered" else None, 10, actual, late, score, text, before)


def test_bucket_edges(frame):
    edges = [0, 7, 8, 14, 15, 21, 22, 30, 31, 400]
    found = delivery.with_delay_bucket(frame(SCHEMA, *[order(i, actual=a) for i, a in enumerate(edges)]))
    assert [b for _, b in sorted(rows(found, "actual_days", "bucket"))] == [
        "0-7", "0-7", "8-14", "8-14", "15-21", "15-21", "22-30", "22-30", "31+", "31+",
    ]
    own = delivery.with_delay_bucket(frame(SCHEMA, order(1, actual=3), order(2, actual=9)), edges=(2, 5))
    assert sorted(rows(own, "bucket")) == [("3-5",), ("6+",)]


def test_scope(frame):
    found = one(
        delivery.scope_summary(
            frame(
                SCHEMA,
                order(1, purchased="2018-01-05 23:00:00", text=True),
                order(2, purchased="2018-01-09 10:00:00", score=None),
                order(3, purchased="2017-01-01 10:00:00", status="shipped"),
            )
        )
    )
    assert found == {
        "orders": 3,
        "delivered": 2,
        "first_purchase": dt.date(2018, 1, 5),
        "last_purchase": dt.date(2018, 1, 9),
        "reviewed": 1,
        "reviewed_with_text": 1,
    }


def test_months_are_half_open_and_sorted(frame):
    delivered = delivery.with_delay_bucket(
        frame(
            SCHEMA,
            order(1, purchased="2018-02-01 00:00:00", late=True),
            order(2, purchased="2018-01-31 23:59:59"),
            order(3, purchased="2018-03-01 00:00:00"),
            order(4, purchased="2017-12-31 23:59:59"),
        )
    )
    months = delivery.monthly_promise(delivered, dt.date(2018, 1, 1), dt.date(2018, 3, 1))
    assert rows(months, "month", "orders", "late_rate") == [("2018-01", 1, 0.0), ("2018-02", 1, 1.0)]


def test_peaks(frame):
    months = frame(
        "month string, late_rate double", ("1", 0.20), ("2", 0.15), ("3", 0.11), ("4", 0.13), ("5", 0.14), ("6", 0.14)
    )
    # 2 does not reach past 1, but nothing higher follows it; 4 is exceeded by 5; equal months both stay.
    assert [m for (m,) in rows(delivery.late_peaks(months), "month")] == ["1", "2", "5", "6"]


def test_delay_vs_promise_order_and_rates(frame):
    delivered = delivery.with_delay_bucket(
        frame(
            SCHEMA,
            order(1, actual=40, late=True, score=1),
            order(2, actual=9, late=True, score=1),
            order(3, actual=9, late=False, score=2),
            order(4, actual=9, late=False, score=3),
            order(5, actual=3, score=None),
        )
    )
    assert rows(delivery.delay_vs_promise(delivered)) == [
        ("8-14", False, 2, 0.5),
        ("8-14", True, 1, 1.0),
        ("31+", True, 1, 1.0),
    ]


def test_bad_review_timing_skips_nulls(frame):
    delivered = delivery.with_delay_bucket(
        frame(
            SCHEMA,
            order(1, late=True, score=1, before=True),
            order(2, late=False, score=2, before=False),
            order(3, late=None, score=5, before=None),
            order(4, late=True, score=None, before=True),
        )
    )
    assert one(delivery.bad_review_timing(delivered)) == {
        "bad": 2,
        "bad_late": 1,
        "bad_before_delivery": 1,
        "reviewed_before_delivery": 1,
        "late_rate_before_delivery": 1.0,
        "avg_score_before_delivery": 1.0,
        "avg_score_after_delivery": 2.0,
    }
