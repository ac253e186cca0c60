import datetime as dt
from decimal import Decimal

import pytest

from helpers import one, rows
from parcelwise.plans import staging
from parcelwise.sources.raw import RAW_COLUMNS, ContractError, check_contract, describe, read_csv_text


def text_schema(table):
    return ", ".join(f"{column} string" for column in RAW_COLUMNS[table])


def test_orders_get_types(frame):
    raw = frame(
        text_schema("orders"),
        ("o1", "c1", "delivered", "2018-01-02 10:11:12", "", "2018-01-03 00:00:00", None, "2018-01-20 00:00:00"),
    ).replace("", None)
    row = one(staging.stg_orders(raw))
    assert row["purchased_at"] == dt.datetime(2018, 1, 2, 10, 11, 12)
    assert row["approved_at"] is None and row["delivered_at"] is None
    assert row["estimated_delivery_date"] == dt.date(2018, 1, 20)


def test_bad_number_stops(frame):
    raw = frame(text_schema("order_payments"), ("o1", "one", "card", "1", "10.00"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        staging.stg_order_payments(raw).collect()


def test_items_and_payments_are_decimals(frame):
    item = one(
        staging.stg_order_items(
            frame(text_schema("order_items"), ("o1", "1", "p1", "s1", "2018-01-05 00:00:00", "10.5", "0.99"))
        )
    )
    assert (item["order_item_id"], item["price"], item["freight_value"]) == (1, Decimal("10.50"), Decimal("0.99"))
    payment = one(staging.stg_order_payments(frame(text_schema("order_payments"), ("o1", "1", "card", "3", "11.49"))))
    assert (payment["payment_installments"], payment["payment_value"]) == (3, Decimal("11.49"))


def test_states_are_upper_case(frame):
    customers = staging.stg_customers(frame(text_schema("customers"), ("c1", "u1", "01000", "campinas", "sp")))
    sellers = staging.stg_sellers(frame(text_schema("sellers"), ("s1", "02000", "rio", "rj")))
    assert rows(customers) == [("c1", "u1", "01000", "campinas", "SP")]
    assert rows(sellers) == [("s1", "02000", "rio", "RJ")]


def test_product_category_falls_back(frame):
    nothing = [None] * 6
    products = frame(
        text_schema("products"), ("p1", "beleza", *nothing, None), ("p2", "novo", *nothing, None), ("p3", None, *nothing, None)
    )
    translation = frame(text_schema("category_translation"), ("beleza", "beauty"))
    found = dict(rows(staging.stg_products(products, translation), "product_id", "category"))
    assert found == {"p1": "beauty", "p2": "novo", "p3": "unknown"}


REVIEWS = text_schema("order_reviews")


def test_latest_answered_review_wins_then_lowest_id(frame):
    raw = frame(
        REVIEWS,
        ("r1", "o1", "1", None, None, "2018-01-01 00:00:00", "2018-01-02 00:00:00"),
        ("r2", "o1", "5", None, None, "2018-01-01 00:00:00", "2018-01-03 00:00:00"),
        ("r4", "o2", "2", None, None, "2018-01-01 00:00:00", "2018-01-03 00:00:00"),
        ("r3", "o2", "4", None, None, "2018-01-01 00:00:00", "2018-01-03 00:00:00"),
        ("r5", "o3", "3", None, None, "2018-01-01 00:00:00", None),
        ("r6", "o3", "1", None, None, "2018-01-01 00:00:00", "2017-01-01 00:00:00"),
        # One review on two orders: both keep it.
        ("r2", "o4", "5", None, None, "2018-01-01 00:00:00", "2018-01-03 00:00:00"),
    )
    kept = staging.stg_order_reviews(raw)
    assert sorted(rows(kept, "order_id", "review_id", "review_score")) == [
        ("o1", "r2", 5),
        ("o2", "r3", 4),
        ("o3", "r6", 1),
        ("o4", "r2", 5),
    ]


def test_review_dedup_drops_rows_before_the_shuffle(frame):
    kept = staging.latest_review_per_order(
        frame("order_id string, review_id string, review_answered_at timestamp_ntz", ("o", "r", "2018-01-01"))
    )
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_blank_review_text_is_missing_but_line_breaks_stay(frame):
    raw = frame(
        REVIEWS,
        ("r1", "o1", "1", "   ", "  ", None, None),
        ("r2", "o2", "1", " ok ", ' said "no"\n ', None, None),
        ("r3", "o3", "1", "\t", "", None, None),
    )
    found = {r["order_id"]: (r["review_title"], r["review_message"]) for r in staging.typed_reviews(raw).collect()}
    assert found["o1"] == (None, None)
    assert found["o2"] == ("ok", 'said "no"\n')
    assert found["o3"] == ("\t", None)


def test_csv_keeps_line_breaks_and_quotes_and_reads_text(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text('review_id,review_score,review_comment_message\nr1,5,"two\nlines, ""quoted"""\nr2,,""\n', encoding="utf-8")
    df = read_csv_text(spark, str(path))
    assert {kind for _, kind in df.dtypes} == {"string"}
    assert sorted(rows(df)) == [("r1", "5", 'two\nlines, "quoted"'), ("r2", None, None)]
    assert rows(describe(df), "column", "type")[0] == ("review_id", "string")


def test_contract_names_the_missing_columns(frame):
    df = frame("seller_id string, seller_city string, extra string", ("s", "c", "x"))
    with pytest.raises(ContractError, match=r"sellers.*seller_state.*seller_zip_code_prefix"):
        check_contract(df, "sellers")
    whole = frame(text_schema("sellers") + ", extra string", ("s", "z", "c", "st", "x"))
    assert check_contract(whole, "sellers") is whole
