"""Tables that are replaced together: written beside the old ones, then made current in one step.

A folder holds versions, each with the tables of one write and a list of what every table of the folder is read from, and
commits, empty files whose names number the versions. The last commit is what readers follow, so a write that fails at any
point leaves the tables as they were, and readers of an older version can go on until it expires.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

KEPT = 2


class MissingTable(LookupError):
    """A folder has no such table, or nothing was committed in it."""


class _Files:
    """Small files of a folder on any file system Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.java = spark.sparkContext._jvm
        self.folder = folder.rstrip("/")
        self.system = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.java.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.system.listStatus(path)) if self.system.exists(path) else []

    def write(self, name: str, text: str = "") -> None:
        out = self.system.create(self._path(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        stream = self.system.open(self._path(name))
        lines = self.java.java.io.BufferedReader(self.java.java.io.InputStreamReader(stream, "UTF-8"))
        try:
            return lines.readLine()
        finally:
            lines.close()

    def remove(self, name: str) -> None:
        self.system.delete(self._path(name), True)


def _commits(files: _Files) -> list[str]:
    """Names of the commits, oldest first: a number and the version."""
    return files.names("commits")


def _listed(files: _Files, commit: str) -> dict[str, str]:
    """Table name to place below the folder, as of a commit."""
    return json.loads(files.read(f"versions/{commit.split('-')[1]}/tables.json"))


def current(spark: SparkSession, folder: str) -> dict[str, str]:
    """Table name to path of what is current; nothing where nothing was committed."""
    files = _Files(spark, folder)
    commits = _commits(files)
    return {name: f"{files.folder}/{place}" for name, place in _listed(files, commits[-1]).items()} if commits else {}


@dataclass
class Version:
    """A write that is under way."""

    folder: str
    name: str
    tables: dict[str, str] = field(default_factory=dict)

    def place(self, table: str) -> str:
        """Where the table is to be written."""
        self.tables[table] = f"versions/{self.name}/{table}"
        return f"{self.folder}/{self.tables[table]}"


@contextmanager
def replacing(spark: SparkSession, folder: str, keep: int = KEPT) -> Iterator[Version]:
    """A new version, committed when the block ends; if the block fails, what it wrote is deleted.

    Tables that the block does not write stay as they are. Versions that only older commits than the last ``keep`` name
    are deleted. Of two writers at once both versions are whole, and the later commit is the one that counts.
    """
    files = _Files(spark, folder)
    version = Version(files.folder, uuid.uuid4().hex)
    try:
        yield version
    except BaseException:
        files.remove(f"versions/{version.name}")
        raise
    before = _commits(files)
    listed = _listed(files, before[-1]) if before else {}
    files.write(f"versions/{version.name}/tables.json", json.dumps(listed | version.tables))
    number = int(before[-1].split("-")[0]) + 1 if before else 1
    files.write(f"commits/{number:010d}-{version.name}")
    expire(spark, folder, keep)


def expire(spark: SparkSession, folder: str, keep: int = KEPT) -> None:
    """Delete all commits but the last ``keep``, and the versions none of these reads from."""
    files = _Files(spark, folder)
    commits = _commits(files)
    old, kept = commits[: -max(keep, 1)], commits[-max(keep, 1) :]
    if not old:
        return
    needed = {commit.split("-")[1] for commit in kept}
    for commit in kept:
        needed |= {place.split("/")[1] for place in _listed(files, commit).values()}
    gone = {place.split("/")[1] for commit in old for place in _listed(files, commit).values()}
    gone |= {commit.split("-")[1] for commit in old}
    # First the commits, so that no commit names a version that is being deleted.
    for commit in old:
        files.remove(f"commits/{commit}")
    for version in gone - needed:
        files.remove(f"versions/{version}")


def replace(
    tables: Mapping[str, DataFrame],
    folder: str,
    partition_by: Mapping[str, Sequence[str]] | None = None,
    keep: int = KEPT,
) -> dict[str, DataFrame]:
    """Write each relation as Parquet and make all of them current at once; returns the written tables."""
    spark = next(iter(tables.values())).sparkSession
    with replacing(spark, folder, keep) as version:
        for name, df in tables.items():
            df.write.partitionBy(*(partition_by or {}).get(name, [])).parquet(version.place(name))
    return open_current(spark, folder, list(tables))


def open_current(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The current tables of these names, all as of one commit."""
    places = current(spark, folder)
    missing = sorted(set(names) - set(places))
    if missing:
        raise MissingTable(f"{folder}: {missing}")
    return {name: spark.read.parquet(places[name]) for name in names}
