import datetime as dt

from pyspark.sql import functions as F

from helpers import one, rows
from parcelwise.plans import publish

METRICS = "section string, key string, ordinal bigint, metric string, value double, text string"


def test_metric_rows_number_lists_and_keep_text(frame):
    months = frame("month string, late_rate double, orders bigint", ("2018-02", 0.5, 2), ("2018-01", 0.25, 4))
    found = publish.metric_rows(months, "monthly", F.col("month"), [F.col("month").asc()])
    assert sorted(rows(found), key=str) == sorted(
        [
            ("monthly", "2018-01", 0, "month", None, "2018-01"),
            ("monthly", "2018-01", 0, "late_rate", 0.25, None),
            ("monthly", "2018-01", 0, "orders", 4.0, None),
            ("monthly", "2018-02", 1, "month", None, "2018-02"),
            ("monthly", "2018-02", 1, "late_rate", 0.5, None),
            ("monthly", "2018-02", 1, "orders", 2.0, None),
        ],
        key=str,
    )
    single = publish.metric_rows(months.agg(F.sum("orders").alias("orders")), "scope")
    assert rows(single) == [("scope", None, None, "orders", 6.0, None)]
    paths = {path: value for path, value, _ in rows(publish.metric_paths(found.unionByName(single)))}
    assert paths["monthly.1.late_rate"] == 0.5 and paths["monthly.length"] == 2.0 and paths["scope.orders"] == 6.0


def test_snapshot_diff_and_publication_date(frame):
    old = frame(METRICS, ("s", None, None, "a", 1.0, None), ("s", None, None, "b", 2.0, None), ("s", "k", 0, "c", None, "x"))
    new = frame(METRICS, ("s", None, None, "a", 1.0, None), ("s", None, None, "b", 3.0, None), ("s", "k", 1, "c", None, "x"))
    diff = publish.metrics_snapshot_diff(new, old)
    assert sorted(rows(diff, "metric", "ordinal", "change", "old_value", "new_value"), key=str) == [
        ("b", None, "changed", 2.0, 3.0),
        ("c", 0, "removed", None, None),
        ("c", 1, "added", None, None),
    ]
    first, today = dt.date(2018, 1, 1), dt.date(2018, 2, 2)
    assert one(publish.publication_date(diff, first, today)) == {"changed_figures": 3, "generated_on": today}
    same = publish.metrics_snapshot_diff(old, old)
    assert one(publish.publication_date(same, first, today)) == {"changed_figures": 0, "generated_on": first}
    assert one(publish.publication_date(same, None, today))["generated_on"] == today


def figure(key, code, shown):
    return f'<span data-k="{key}" data-f="{code}">{shown}</span>'


def test_reconcile_reads_formatted_figures(frame):
    metrics = frame(
        METRICS,
        ("scope", None, None, "delivered", 96470.0, None),
        ("scope", None, None, "last_purchase", None, "2018-08-29"),
        ("backtest.policies", None, 1, "new_late_rate", 0.06923, None),
        ("repeat", None, None, "difference", -0.00441, None),
    )
    right = [
        figure("scope.delivered", "int", "96 470"),
        figure("scope.delivered", "n0", " 96&nbsp;470\n"),
        figure("scope.last_purchase", "date", "29 août 2018"),
        figure("backtest.policies.1.new_late_rate", "pct", "6,9 %"),
        figure("backtest.policies.1.new_late_rate", "pct0", "7 %"),
        figure("backtest.policies.1.new_late_rate", "n2", "0,07"),
        figure("repeat.difference", "pct2", "−0,44 %"),
        figure("backtest.policies.length", "int", "1"),
    ]
    wrong = [
        figure("scope.delivered", "int", "96 471"),
        figure("scope.last_purchase", "date", "30 août 2018"),
        figure("backtest.policies.1.new_late_rate", "pct", "7,0 %"),
        figure("repeat.difference", "pct2", "0,44 %"),
        figure("scope.delivered", "int", "many"),
        figure("scope.missing", "int", "1"),
        figure("scope.delivered", "roman", "X"),
    ]
    pages = frame("page string, html string", ("good", "\n".join(right)), ("bad", "<p>".join(wrong)), ("none", "no figures"))
    assert publish.published_figures(pages).count() == len(right) + len(wrong)
    found = publish.reconcile_published(pages, metrics)
    assert {page for (page,) in rows(found, "page")} == {"bad"}
    problems = sorted(p for (p,) in rows(found, "problem"))
    assert problems == ["differs"] * 5 + ["unknown format", "unknown key"]


def test_update_notice_is_due_only_after_a_change(frame):
    pages = frame("page string, html string", ("with", '<p class="updated">'), ("without", "<p>"))
    first, later = dt.date(2018, 1, 1), dt.date(2018, 2, 2)
    assert rows(publish.update_notice_mismatch(pages, first, first), "page") == [("with",)]
    assert rows(publish.update_notice_mismatch(pages, later, first), "page") == [("without",)]


def test_derived_figures(frame):
    delay = frame(
        "bucket string, is_late boolean, orders bigint, bad_rate double",
        ("0-7", False, 900, 0.1),
        ("0-7", True, 99, 0.9),
        ("8-14", False, 900, 0.1),
        ("8-14", True, 100, 0.3),
        ("15-21", False, 900, 0.2),
        ("15-21", True, 200, 0.4),
    )
    found = one(
        publish.derived_figures(
            delay,
            frame("bad bigint, bad_before_delivery bigint", (10, 4)),
            frame("late_orders bigint, late_with_seller_on_time bigint", (8, 2)),
            frame("late_orders bigint", (50,)),
            frame("excess_late double", (5.0,)),
            frame(
                "old_promise double, new_promise double, old_bad_reviews double, new_bad_reviews double, old_late_rate double, "
                "new_late_rate double",
                (20.0, 20.5, 100.4, 89.6, 0.08, 0.06),
            ),
        )
    )
    expected = {
        "late_vs_on_time_ratio_min": 2.0,
        "late_vs_on_time_ratio_max": 3.0,
        "late_share_seller_on_time": 0.25,
        "bad_share_before_delivery": 0.4,
        "bad_in_bucket_on_time": 0.2,
        "bad_in_bucket_late": 0.4,
        "policy_extra_days": 0.5,
        "policy_bad_avoided": 10.0,
        "policy_bad_avoided_share": 0.1,
        "policy_late_avoided_share": 0.25,
        "excess_late_share": 0.1,
    }
    assert found.keys() == expected.keys()
    assert all(abs(found[name] - value) < 1e-9 for name, value in expected.items())


# The keys that the study's page cites.
CITED = """
backtest.margins.5.late_avoided_share backtest.margins.5.new_late_rate backtest.margins.5.new_promise
backtest.policies.0.new_bad_reviews backtest.policies.0.new_late_rate backtest.policies.0.new_promise
backtest.policies.1.new_bad_reviews backtest.policies.1.new_late_rate backtest.policies.1.new_promise
backtest.policies.1.shop_bad_reviews backtest.policies.1.shop_late_rate backtest.policies.1.shop_promise
backtest.policies.1.orders backtest.policies.2.march_late_rate backtest.policies.2.new_late_rate
backtest.policies.2.new_promise backtest.risky_routes.routes bad_reviews.avg_score_after_delivery
bad_reviews.avg_score_before_delivery bad_reviews.bad bad_reviews.bad_before_delivery
bad_reviews.late_rate_before_delivery bad_reviews.reviewed_before_delivery delay_vs_promise.1.orders
derived.bad_15_21_late derived.bad_15_21_on_time derived.bad_share_before_delivery derived.excess_late_share
derived.late_share_seller_on_time derived.late_vs_on_time_ratio_max derived.late_vs_on_time_ratio_min
derived.risky_plus5_bad_avoided derived.risky_plus5_bad_avoided_share derived.risky_plus5_extra_days
derived.risky_plus5_late_avoided_share generated_on handover.carrier_days_late handover.carrier_days_on_time
handover.late_rate_if_seller_late handover.late_rate_if_seller_on_time handover.seller_days_late
handover.seller_days_on_time handover.seller_late_orders monthly.10.late_rate monthly.14.late_rate
monthly.17.actual_days monthly.17.promised_days pitfalls.customer_ids pitfalls.delivered_before_shipped
pitfalls.orders_with_several_reviews pitfalls.partial_months pitfalls.payment_mismatch
pitfalls.reviews_on_several_orders pitfalls.shipped_before_purchase pitfalls.unique_customers published_on
repeat.eligible_customers repeat.repeat_if_on_time repeat.state_adjusted.late
repeat.state_adjusted.on_time_standardised repeat.state_adjusted.z routes.length scope.delivered scope.reviewed
scope.reviewed_with_text sellers.excess_late sellers.excess_sellers sellers.late_orders
""".split()


def test_every_cited_key_has_a_figure(spark):
    from workload.queries import registered

    metrics = registered()["metrics_table"](spark, "/root/testdata/sf0.01").cache()
    pages = spark.createDataFrame([("p", "".join(figure(k, "n2", "0") for k in CITED))], "page string, html string")
    found = publish.reconcile_published(pages, metrics)
    assert rows(found.where("problem = 'unknown key'"), "key") == []
    named = dict(rows(metrics.where("section = 'backtest.policies' and metric = 'policy'"), "ordinal", "text"))
    assert named[0] == "route_quantile" and named[1].startswith("risky_routes_plus") and named[2].startswith("rolling")
    classes = [k.split()[0] for _, k in sorted(set(rows(metrics.where("section = 'delay_vs_promise'"), "ordinal", "key")))]
    assert classes == sorted(classes, key=lambda c: int(c.rstrip("+").split("-")[0]))


def test_dates_are_figures(frame):
    dated = publish.dated(frame(METRICS, ("s", None, None, "a", 1.0, None)), dt.date(2018, 2, 3), dt.date(2018, 1, 1))
    assert dict(rows(publish.metric_paths(dated), "path", "text")) == {
        "s.a": None,
        "generated_on": "2018-02-03",
        "published_on": "2018-01-01",
    }
    page = figure("generated_on", "date", "3 f&eacute;vrier 2018") + figure("published_on", "date", "2 janvier 2018")
    found = publish.reconcile_published(frame("page string, html string", ("p", page)), dated)
    assert rows(found, "key", "problem") == [("published_on", "differs")]


def test_cited_rule_is_the_row_of_the_grid(frame):
    grid = frame("margin int, new_promise double, new_late_rate double, new_bad_reviews double", (4, 1.0, 2.0, 3.0), (5, 1.5, 2.5, 3.5))
    policy = frame("new_promise double, new_late_rate double, new_bad_reviews double", (1.5, 2.5, 3.0))
    assert rows(publish.cited_margin_mismatch(grid, policy, 5)) == [("new_bad_reviews", 3.0, 3.5)]
    assert publish.cited_margin_mismatch(grid, policy, 6).count() == 3
