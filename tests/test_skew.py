"""Order-dependent operators with one key that holds most rows, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from parcelwise.operators.lookups import lookup
from parcelwise.operators.slices import range_slices, ranked_sequence, running_totals

SCHEMA = "person string, at timestamp_ntz, id string"


def purchases():
    rng = random.Random(3)
    start = dt.datetime(2018, 1, 1)
    data = []
    for i in range(3000):
        person = rng.choice(["hot", "hot", "warm", f"p{i % 400}", None])
        # Many ties, and some orders without a time.
        at = None if rng.random() < 0.03 else start + dt.timedelta(days=rng.randrange(20))
        data.append((person, at, f"{i:05d}"))
    return data


DATA = purchases()


def plain_ranks():
    found, groups = {}, {}
    for row in DATA:
        groups.setdefault(row[0], []).append(row)
    for group in groups.values():
        group.sort(key=lambda r: (r[1] is None, r[1] or dt.datetime.min, r[2]))
        for place, row in enumerate(group):
            following = group[place + 1][1] if place + 1 < len(group) else None
            found[row[2]] = (place + 1, following)
    return found


@pytest.mark.parametrize("slices", [None, 1, 2, 7, 60])
def test_ranks_do_not_depend_on_the_slices(frame, slices):
    ranked = ranked_sequence(frame(SCHEMA, *DATA), "person", ["at", "id"], "place", "next_at", slices)
    found = {i: (place, following) for i, place, following in rows(ranked, "id", "place", "next_at")}
    assert found == plain_ranks()


@pytest.mark.parametrize("share", [0.001, 0.5])
def test_no_slice_holds_a_hot_buyer_whole(spark, share):
    n = 40_000
    buyer = F.when(F.col("id") % 1000 < int(1000 * share), F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id")))
    df = spark.range(n).select(buyer.alias("person"), (F.col("id") * 7919 % n).alias("at"), "id")
    slices = range_slices(df, [F.col("person"), F.col("at"), F.col("id")], 16).groupBy("_slice").count()
    assert slices.agg(F.max("count")).first()[0] < 3 * n / 16
    ranked = ranked_sequence(df, "person", ["at", "id"], "place", "next_at", 16).where("person = 'hot'")
    found = sorted(rows(ranked, "at", "place", "next_at"))
    assert [place for _, place, _ in found] == list(range(1, int(n * share) + 1))
    assert [following for _, _, following in found] == [at for at, _, _ in found][1:] + [None]


def test_no_rows_no_ranks(frame):
    none = frame(SCHEMA, *DATA).where("id = 'nobody'")
    assert rows(ranked_sequence(none, "person", ["at", "id"], "place", "next_at", 4)) == []


@pytest.mark.parametrize("slices", [2, 9])
def test_running_totals_without_a_partition_key(frame, slices):
    rng = random.Random(8)
    data = [(i, rng.randrange(4), rng.choice([None, 1, 5])) for i in range(500)]
    df = frame("id bigint, late bigint, orders bigint", *data)
    found = running_totals(
        df,
        [F.col("late").desc_nulls_last(), F.col("id").asc_nulls_last()],
        {"cum_late": "late", "cum_orders": "orders"},
        "place",
        slices,
    )
    expected, late, orders = {}, 0, 0
    for place, (i, bad, n) in enumerate(sorted(data, key=lambda r: (-r[1], r[0])), 1):
        late, orders = late + bad, orders + (n or 0)
        expected[i] = (place, late, orders)
    assert {r["id"]: (r["place"], r["cum_late"], r["cum_orders"]) for r in found.collect()} == expected
    assert {tuple(r) for r in found.select("cum_late_all", "cum_orders_all").collect()} == {(late, orders)}


def test_lookup_keeps_rows_without_key_and_spreads_them(spark, frame):
    data = [(str(i), None if i % 2 else f"s{i % 3}") for i in range(400)]
    facts = frame("order_id string, seller_id string", *data)
    sellers = frame("seller_id string, seller_state string", ("s0", "SP"), ("s1", "RJ"), ("s5", "MG"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup(facts, sellers, "seller_id", spread_by="order_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "_spread" in plan.split("SortMergeJoin")[1].split("\n")[0] and "SinglePartition" not in plan
        found = dict(rows(joined, "order_id", "seller_state"))
        partitions = joined.where("seller_id is null").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    states = {"s0": "SP", "s1": "RJ"}
    assert found == {order: states.get(seller) for order, seller in data}
    assert sum(r["count"] for r in partitions) == 200
