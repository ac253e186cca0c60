"""Helpers the training-data operators have in common."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parcelwise.session import materialised, tune

# Rows and bytes of one Arrow batch between Spark and a Python worker: long texts must not add up to gigabytes.
ROWS_PER_BATCH = 512
BYTES_PER_BATCH = 16 << 20

# Bitmaps of 32768 bits, 4 KB each, that sort out rows without a partner before a join, whatever the input.
BITMAPS = 1024

# Rounds of the component search; it settles in a logarithmic number.
STAR_ROUNDS = 60


def prepared(spark: SparkSession) -> SparkSession:
    """Runtime settings of the operators: bounded Arrow batches and adaptive execution."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, schema: str, rows: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """``df`` through ``rows``, a function from batches of columns (name to list) to such batches of ``schema``."""
    target = StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in rows(batch.to_pydict() for batch in batches):
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, target)


def with_columns(df: DataFrame, column: str, schema: str, values: Callable[[list], dict]) -> DataFrame:
    """``df`` and further columns of ``schema``, which ``values`` makes of one column's values, batch by batch.

    The other columns pass through untouched, whatever their names; new names must not be among them.
    """
    added = StructType.fromDDL(schema)
    target = StructType(df.schema.fields + added.fields)
    arrow, place = to_arrow_schema(target), df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = values(batch.column(place).to_pylist())
            new = [pa.array(made[f.name], arrow.field(len(batch.columns) + i).type) for i, f in enumerate(added.fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=arrow)

    return df.mapInArrow(run, target)


def merge_classes(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of linked positions; ``label`` keeps the smallest position of each class."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label[:] = jumped


def probably_in(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose long ``key`` is probably among those of ``wanted`` (``key``), found without a shuffle of ``df``.

    ``wanted`` sets bits in a bitmap of fixed size, which is what is broadcast; no wanted row is lost, others may slip
    through. An exact join must follow.
    """
    bits = BITMAPS * 32768
    spread = f"pmod({key}, {bits}L)"
    maps = wanted.groupBy(F.expr(f"cast({spread} div 32768 as int)").alias("_map")).agg(
        F.expr(f"bitmap_construct_agg(pmod({key}, 32768L))").alias("_bitmap")
    )
    byte = f"cast(conv(hex(substring(_bitmap, cast(pmod({key}, 32768L) div 8 as int) + 1, 1)), 16, 10) as int)"
    return (
        df.withColumn("_map", F.expr(f"cast({spread} div 32768 as int)"))
        .join(F.broadcast(maps), "_map")  # at most BITMAPS rows of 4 KB
        .where(F.expr(f"shiftright({byte}, cast(pmod({key}, 8L) as int)) & 1 = 1"))
        .select(*df.columns)
    )


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node ``a`` has one edge and no ``b`` is the ``a`` of another: then each ``b`` is a root."""
    nodes = edges.groupBy("a").agg(F.count("*").alias("n"))
    if not nodes.where("n > 1").isEmpty():
        return False
    inner = edges.join(nodes.select(F.col("a").alias("node")), F.col("b") == F.col("node"), "left_semi")
    return inner.isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (``a``, ``b``): one row (``node``, ``root``) for every node with an edge.

    ``root`` is the smallest node of the component. Alternating large-star and small-star rounds: each round is
    an aggregation with map-side combine and a join, written to the shared folder, so nothing is collected and
    a lost executor repeats one round at most. Null ends and loops are ignored; no edges give no rows.
    """
    current = materialised(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    for _ in range(STAR_ROUNDS):
        if _is_star_forest(current):
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = (
            both.join(nearest, F.col("a") == F.col("c"))
            .where("b > a and b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        large = materialised(large)
        lowest = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
        small = (
            large.join(lowest, F.col("a") == F.col("c"))
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(lowest.select(F.col("c").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        current = materialised(small)
    else:
        raise RuntimeError(f"components did not settle in {STAR_ROUNDS} rounds")
    members = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.unionByName(members.select(F.col("root").alias("node"), "root").distinct())
