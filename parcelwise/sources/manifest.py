"""What was loaded: files, digests, row counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.session import materialised

# No file is as large, so a task that reads plain text gets one file, and all of it.
WHOLE_FILE = 1 << 44
MARK = b"\xef\xbb\xbf"


@contextmanager
def _whole_files(spark: SparkSession) -> Iterator[None]:
    """Inside, a file is read by one task from its start to its end."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, f"{WHOLE_FILE}b")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _packed(spark: SparkSession, paths: list[str]) -> Column:
    """Whether a text reader unpacks the file of a row; ``paths`` are all there are."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    codecs = hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration())
    used = [codec for path in paths if (codec := codecs.getCodec(hadoop.fs.Path(path))) is not None]
    packed = F.lit(False)
    for ending in sorted({codec.getDefaultExtension() for codec in used}):
        packed |= F.col("_metadata.file_name").endswith(ending)
    return packed


def _line_digests(lines: DataFrame) -> DataFrame:
    """``_path`` and ``sha256`` of files whose ``_bytes`` come line by line, each with its line feed, in order.

    The text reader drops a byte order mark and does not tell whether the last line was closed; the size of the file tells both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            missing = size - read
            if missing not in (0, -1, 2, 3):
                raise OSError(f"{path}: {size} bytes listed, {read} read")
            digest = marked if missing > 0 else plain
            if missing in (0, 3):
                digest.update(b"\n")
            return pa.RecordBatch.from_pydict({"_path": [path], "sha256": [digest.hexdigest()]})

        path = None
        for batch in batches:
            runs = pc.run_end_encode(batch.column(0))
            content = batch.column(2).cast(pa.large_binary())
            ends = np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + len(content) + 1]
            data = memoryview(content.buffers()[2])
            first = 0
            for found, last in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if found != path:
                    if path is not None:
                        yield out()
                    path, size, read = found, batch.column(1)[first].as_py(), 0
                    plain, marked = hashlib.sha256(), hashlib.sha256(MARK)
                elif read:
                    # The line feed of the line before, which was not the last.
                    plain.update(b"\n")
                    marked.update(b"\n")
                piece = data[ends[first] : ends[last]]
                read += len(piece)
                plain.update(piece[:-1])
                marked.update(piece[:-1])
                first = last
        if path is not None:
            yield out()

    return lines.mapInArrow(run, "_path string, sha256 string")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per file that is not empty, written when called.

    A digest needs all bytes in order, so each file goes through one task, line by line: memory follows the longest line,
    not the file. A compressed file is one row, which fits files below 2 GB.
    """
    every = spark.read.format("binaryFile").load(path)
    place = F.col("_metadata.file_path")
    packed = _packed(spark, every.inputFiles())
    content = F.concat("value", F.lit("\n")).cast("binary")
    lines = spark.read.option("lineSep", "\n").text(path).where(~packed)
    digests = _line_digests(lines.select(place.alias("_path"), F.col("_metadata.file_size").alias("_size"), content.alias("_bytes")))
    whole = every.where(packed).select(place.alias("_path"), F.sha2("content", 256).alias("sha256"))
    digests = digests.unionByName(whole)
    with _whole_files(spark):
        digests = materialised(digests)
    # A file without any line holds nothing but a mark.
    listed = every.select(
        place.alias("_path"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes")
    )
    return listed.join(digests, "_path", "left").select(
        "file", F.coalesce("sha256", F.lit(hashlib.sha256(MARK).hexdigest())).alias("sha256"), "bytes"
    )


def check_digests(digests: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose digest is not among the expected (file, sha256) rows."""
    return digests.join(expected.select("file", "sha256"), ["file", "sha256"], "left_anti")


def manifest_rows(digests: DataFrame, tables: Mapping[str, DataFrame], file_column: str) -> DataFrame:
    """One row per loaded file: source, file, sha256, rows, loaded_at.

    ``digests`` carries the table name in ``source``, the tables the name of each row's file in ``file_column``. A
    file without data rows counts 0.
    """
    counts = None
    for table, df in tables.items():
        found = df.groupBy(F.col(file_column).alias("file")).agg(F.count(F.lit(1)).alias("rows"))
        found = found.withColumn("source", F.lit(table))
        counts = found if counts is None else counts.unionByName(found)
    return digests.join(counts, ["source", "file"], "left").select(
        "source",
        "file",
        "sha256",
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
        F.current_timestamp().alias("loaded_at"),
    )
