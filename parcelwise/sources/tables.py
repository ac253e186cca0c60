"""Named tables: temporary views for cheap relations, Parquet for marts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

from parcelwise.sources import versions


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Make the relations available to ``spark.sql`` by name; nothing is computed."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def save_tables(
    tables: Mapping[str, DataFrame],
    folder: str,
    mode: str = "overwrite",
    partition_by: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, DataFrame]:
    """Write each relation as Parquet under ``folder`` and return the written tables.

    ``overwrite`` replaces all of them at once when all are written, and leaves the old ones if that fails; ``append``
    adds to the current ones. Other tables of the folder stay.
    """
    if mode == "overwrite":
        return versions.replace(tables, folder, partition_by)
    if mode != "append":
        raise ValueError(f"unknown mode {mode}")
    spark = next(iter(tables.values())).sparkSession
    places = versions.current(spark, folder)
    new = {name: df for name, df in tables.items() if name not in places}
    if new:
        versions.replace(new, folder, partition_by)
    for name in tables.keys() & places.keys():
        tables[name].write.mode("append").partitionBy(*(partition_by or {}).get(name, [])).parquet(places[name])
    return versions.open_current(spark, folder, list(tables))


def open_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The current tables of these names."""
    return versions.open_current(spark, folder, names)


def save_bucketed(tables: Mapping[str, DataFrame], folder: str, key: str, buckets: int | None = None) -> dict[str, DataFrame]:
    """Write each relation bucketed and sorted on ``key`` under ``folder`` and return the tables of the catalog.

    Joins, groupings and windows on ``key`` over such tables need no exchange. All get the same number of buckets (the
    session's shuffle partitions by default) and one file per bucket; a bucket should hold some hundred megabytes.
    """
    saved = {}
    for name, df in tables.items():
        count = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        path = f"{folder.rstrip('/')}/{name}"
        dealt = df.repartition(count, key).sortWithinPartitions(key)
        dealt.write.bucketBy(count, key).sortBy(key).options(path=path, compression="zstd").saveAsTable(_catalog_name(path))
        saved[name] = df.sparkSession.table(_catalog_name(path))
    return saved


def open_bucketed(spark: SparkSession, folder: str, names: Sequence[str], key: str, buckets: int) -> dict[str, DataFrame]:
    """Tables that ``save_bucketed`` wrote, also in a session whose catalog does not know them."""
    found = {}
    for name in names:
        path = f"{folder.rstrip('/')}/{name}"
        if not spark.catalog.tableExists(_catalog_name(path)):
            columns = spark.read.parquet(path).schema.toDDL()
            spark.sql(
                f"CREATE TABLE {_catalog_name(path)} ({columns}) USING parquet "
                f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
            )
        found[name] = spark.table(_catalog_name(path))
    return found


def forget_bucketed(spark: SparkSession, folder: str, names: Sequence[str]) -> None:
    """Take tables that ``save_bucketed`` wrote out of the catalog; their files stay."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {_catalog_name(f'{folder.rstrip("/")}/{name}')}")


def _catalog_name(path: str) -> str:
    return f"saved_{sha256(path.encode()).hexdigest()[:32]}"
