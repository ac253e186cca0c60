import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parcelwise.session import remove_written, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    remove_written(session)
    session.stop()


def moment(text):
    return dt.datetime.fromisoformat(text) if text else None


def day(text):
    return dt.date.fromisoformat(text) if text else None


@pytest.fixture(scope="session")
def frame(spark):
    """Build a DataFrame from rows and a DDL schema; texts in time columns are parsed."""

    def build(schema, *rows):
        kinds = [part.split()[1] for part in schema.split(", ")]
        parse = {"timestamp_ntz": moment, "date": day}
        cooked = [
            tuple(parse[k](v) if k in parse and isinstance(v, str) else v for k, v in zip(kinds, row)) for row in rows
        ]
        return spark.createDataFrame(cooked, schema)

    return build
