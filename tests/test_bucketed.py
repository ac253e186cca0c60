import pytest

from helpers import rows
from parcelwise.sources import tables
from workload.study import BucketedStudy, Study

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def order_exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(order_id")


def test_the_fact_over_buckets_needs_no_exchange_of_orders(no_broadcast):
    saved, plain = BucketedStudy(no_broadcast, FOLDER), Study(no_broadcast, FOLDER)
    assert order_exchanges(saved.enriched) == 0 and order_exchanges(plain.enriched) > 0
    assert order_exchanges(saved.fct_orders) == 0
    assert saved.enriched.count() == plain.enriched.count()


def test_buckets_are_known_to_a_new_catalog(no_broadcast, frame, tmp_path):
    schema = "order_id bigint, v int"
    left, right = frame(schema, *[(i, i) for i in range(50)]), frame(schema, *[(i % 10, i) for i in range(50)])
    tables.save_bucketed({"left": left, "right": right}, str(tmp_path), "order_id", buckets=3)
    other = no_broadcast.newSession()
    for name in ("left", "right"):
        other.sql(f"DROP TABLE {tables._catalog_name(f'{tmp_path}/{name}')}")
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = tables.open_bucketed(other, str(tmp_path), ["left", "right"], "order_id", 3)
    joined = found["left"].join(found["right"], "order_id").groupBy("order_id").count()
    assert order_exchanges(joined) == 0
    assert sorted(rows(joined)) == [(i, 5) for i in range(10)]
