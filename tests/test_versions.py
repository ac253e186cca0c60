import os

import pytest

from helpers import rows
from parcelwise.sources import raw, tables, versions
from parcelwise.sources.raw import load_raw


@pytest.fixture
def numbers(frame):
    return lambda *values: frame("n int", *[(v,) for v in values])


def found(spark, folder, *names):
    return {name: sorted(n for (n,) in rows(df)) for name, df in versions.open_current(spark, str(folder), names).items()}


def test_a_failed_replacement_leaves_everything(spark, numbers, tmp_path):
    versions.replace({"a": numbers(1), "b": numbers(2), "c": numbers(3)}, str(tmp_path))
    bad = numbers(9).selectExpr("cast(raise_error('full') as int) as n")
    with pytest.raises(Exception, match="full"):
        versions.replace({"a": numbers(7), "b": numbers(8), "c": bad}, str(tmp_path))
    assert found(spark, tmp_path, "a", "b", "c") == {"a": [1], "b": [2], "c": [3]}
    assert len(os.listdir(tmp_path / "versions")) == 1


def test_readers_keep_their_version_until_it_expires(spark, numbers, tmp_path):
    old = versions.replace({"a": numbers(1), "b": numbers(2)}, str(tmp_path))
    versions.replace({"a": numbers(10)}, str(tmp_path))
    assert rows(old["a"]) == [(1,)] and found(spark, tmp_path, "a", "b") == {"a": [10], "b": [2]}
    versions.replace({"a": numbers(100)}, str(tmp_path))
    versions.replace({"a": numbers(1000)}, str(tmp_path))
    # The first version still holds what "b" is read from; the second is gone.
    assert found(spark, tmp_path, "a", "b") == {"a": [1000], "b": [2]}
    assert len(os.listdir(tmp_path / "versions")) == 3 and len([c for c in os.listdir(tmp_path / "commits") if c[0] != "."]) == 2
    versions.replace({"b": numbers(3)}, str(tmp_path))
    versions.expire(spark, str(tmp_path), keep=1)
    assert found(spark, tmp_path, "a", "b") == {"a": [1000], "b": [3]}
    assert len(os.listdir(tmp_path / "versions")) == 2


def test_missing_tables_and_append(spark, numbers, tmp_path):
    with pytest.raises(versions.MissingTable):
        versions.open_current(spark, str(tmp_path), ["a"])
    tables.save_tables({"a": numbers(1)}, str(tmp_path), mode="append")
    tables.save_tables({"a": numbers(2), "b": numbers(5)}, str(tmp_path), mode="append")
    assert found(spark, tmp_path, "a", "b") == {"a": [1, 2], "b": [5]}
    with pytest.raises(versions.MissingTable, match="c"):
        tables.open_tables(spark, str(tmp_path), ["a", "c"])
    with pytest.raises(ValueError, match="mode"):
        tables.save_tables({"a": numbers(2)}, str(tmp_path), mode="ignore")


def test_a_load_that_fails_in_its_third_table(spark, tmp_path, monkeypatch):
    files = {}
    for table in ("sellers", "customers", "products"):
        path = tmp_path / f"{table}.csv"
        path.write_text(",".join(raw.RAW_COLUMNS[table]) + "\n" + ",".join("1" for _ in raw.RAW_COLUMNS[table]) + "\n")
        files[table] = str(path)
    target = f"{tmp_path}/landed"
    load_raw(spark, files, target)
    for table in files:
        with open(files[table], "a") as out:
            out.write(",".join("2" for _ in raw.RAW_COLUMNS[table]) + "\n")
    read = raw.read_csv_text

    def third_fails(spark, path, file_column=None):
        df = read(spark, path, file_column)
        if "products" not in path:
            return df
        return df.withColumn("product_id", raw.F.raise_error(raw.F.lit("lost")).cast("string"))

    monkeypatch.setattr(raw, "read_csv_text", third_fails)
    with pytest.raises(Exception, match="lost"):
        load_raw(spark, files, target)
    assert {name: df.count() for name, df in raw.open_raw(spark, target, files).items()} == dict.fromkeys(files, 1)
    assert spark.read.parquet(f"{target}/manifest").count() == 3
    monkeypatch.undo()
    load_raw(spark, files, target)
    assert {name: df.count() for name, df in raw.open_raw(spark, target, files).items()} == dict.fromkeys(files, 2)
