"""Session settings and the shared folder for intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans rely on. From measured sizes, AQE turns joins with a small side into broadcasts,
# joins whose partitions are all small into hash joins without sorting, and splits skewed join partitions even
# where that costs one more exchange.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a running session and return it."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session, where driver and executors share one machine, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    current = context.getCheckpointDir()
    if current is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="parcelwise-"))
        current = context.getCheckpointDir()
    return current


_places: list[str] = []


class Scope:
    """Tables written while the scope is open: shared by key, deleted when it is closed."""

    def __init__(self) -> None:
        self.places: list[str] = []
        self.tables: dict[Hashable, DataFrame] = {}


_open: list[Scope] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Inside, results that ask for the same relation read one written table; at the end all tables written inside go.

    So results must be consumed, or written with ``kept``, before the block ends. Scopes may be nested; what an inner
    one writes goes with it. Tables go as well if the block fails.
    """
    opened = Scope()
    _open.append(opened)
    try:
        yield opened
    finally:
        _open.remove(opened)
        remove(spark, opened.places)


@contextmanager
def collected() -> Iterator[list[str]]:
    """Paths of the tables written inside, which the caller deletes when their readers are done."""
    opened = Scope()
    _open.append(opened)
    try:
        yield opened.places
    finally:
        _open.remove(opened)


def in_scope() -> bool:
    return bool(_open)


def new_place(spark: SparkSession, name: str) -> str:
    """Path of a folder not used before, under the shared folder; it belongs to the innermost open scope."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (_open[-1].places if _open else _places).append(path)
    return path


def remove(spark: SparkSession, places: list[str]) -> None:
    """Delete the folders and empty the list."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while places:
        path = hadoop.Path(places.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_written(spark: SparkSession) -> None:
    """Delete the intermediate tables this process wrote outside scopes; call it when their readers are done."""
    remove(spark, _places)


def materialised(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and return the written table.

    Unlike a checkpoint the result is columnar: later reads prune columns and push filters.
    """
    path = new_place(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shared(key: Hashable, build: Callable[[], DataFrame], write: Callable[[DataFrame], DataFrame] = materialised) -> DataFrame:
    """The written table of ``build``; the open scopes keep one per key, without a scope each call writes its own."""
    for opened in reversed(_open):
        if key in opened.tables:
            return opened.tables[key]
    table = write(build())
    if _open:
        _open[-1].tables[key] = table
    return table


def kept(df: DataFrame) -> DataFrame:
    """``df`` written so that it outlives the innermost open scope."""
    inner = _open.pop() if _open else None
    try:
        return materialised(df)
    finally:
        if inner:
            _open.append(inner)
