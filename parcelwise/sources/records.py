"""Records of CSV files that several tasks read, although quoted fields may contain line breaks.

A line alone does not tell whether it starts inside quotes: that depends on all quotes before it. A split is summed up in
one row, the number of its lines with an odd number of quotes; the sums before a split tell how it starts. Records that
lie in one split are put together as its lines are read, without a shuffle; only the lines of records that cross the edges
of splits are shuffled, by the split where their record starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwise.session import materialised

FILE = ["_file", "_block"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with file, split and position; ``_odd`` is 1 where the quotes of a line do not pair up.

    Lines end at line feeds; carriage returns stay, since they may be part of a quoted field.
    """
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_name").alias("_name"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
        F.col("value").alias("_text"),
        ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).alias("_odd"),
    )


def _without_return(text: str) -> Column:
    return F.regexp_replace(text, "\r$", "")


def _splits(lines: DataFrame) -> DataFrame:
    """One row per split: its odd lines, the first and last of them, its first line, and the split that owns the lines up to the first odd one.

    ``_owner`` is null where the split starts outside quotes. A split inside one field leaves it open for the next.
    ``_opens`` is set where a record that starts in the split, at its last odd line, goes on in the next one.
    """
    summed = lines.groupBy(*FILE).agg(
        F.sum("_odd").alias("_odds"),
        F.min(F.when(F.col("_odd") == 1, F.col("_line"))).alias("_first_odd"),
        F.max(F.when(F.col("_odd") == 1, F.col("_line"))).alias("_last_odd"),
        F.min("_line").alias("_first"),
        # Numbers only, so that lines are summed up without being sorted; a null header is none.
        F.min_by(F.when(F.col("_block") == 0, F.xxhash64(_without_return("_text"))), "_line").alias("_header"),
    )
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    entered = F.coalesce(F.sum("_odds").over(before), F.lit(0)) % 2 == 1
    # A record that goes on in the next split starts in this one unless the whole split is part of it.
    opens = F.when((F.col("_inside") != (F.col("_odds") % 2 == 1)) & ~(F.col("_inside") & (F.col("_odds") == 0)), F.col("_block"))
    return (
        summed.withColumn("_inside", entered)
        .withColumn("_opens", opens)
        .withColumn("_owner", F.when(F.col("_inside"), F.last("_opens", ignorenulls=True).over(before)))
        .drop("_inside")
    )


def _joined(lines: DataFrame) -> DataFrame:
    """Records of ``lines`` in the order of their files, where every split starts and ends outside quotes.

    ``lines`` has ``_name``, ``_is_header``, ``_odd`` and ``_bytes``, the line with its line feed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []  # the lines of a record that an earlier batch has begun
        held_header = False
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            names, header, odd = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            content = batch.column(3).cast(pa.large_binary())
            edges = np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + size + 1]
            data = np.frombuffer(content.buffers()[2], np.uint8)[edges[0] : edges[-1]]
            closed = (np.cumsum(odd) + bool(held)) % 2 == 0
            last = np.nonzero(closed)[0]
            if not len(last):
                if not held:
                    held_header = bool(header[0])
                held.append(data.tobytes())
                continue
            first = np.append(0, last[:-1] + 1)
            is_header = header[first]
            if held:
                is_header[0] = held_header
            ends = edges[last + 1] - edges[0]
            rest = data[ends[-1] :]
            kept = np.ones(ends[-1], bool)
            kept[ends - 1] = False
            before = b"".join(held)
            text = pa.py_buffer(before + data[: ends[-1]][kept].tobytes())
            offsets = np.append(0, len(before) + ends - np.arange(1, len(ends) + 1)).astype(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "_name": names.take(pa.array(last)),
                    "_is_header": pa.array(is_header),
                    "_text": pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), text).cast(pa.string()),
                }
            )
            held, held_header = [], False
            if len(rest):
                held, held_header = [rest.tobytes()], bool(header[last[-1] + 1])
        if held:
            raise OSError("a file has changed while it was read")

    return lines.mapInArrow(run, "_name string, _is_header boolean, _text string")


def _whole_records(lines: DataFrame) -> DataFrame:
    """Records put together from lines: ``_name``, ``_is_header``, ``_text``."""
    head = F.col("_owner").isNotNull() & (F.col("_first_odd").isNull() | (F.col("_line") <= F.col("_first_odd")))
    tail = F.col("_opens").isNotNull() & (F.col("_line") >= F.col("_last_odd"))
    inside = _joined(
        lines.where(~(head | tail)).select(
            "_name", "_is_header", "_odd", F.concat("_text", F.lit("\n")).cast("binary").alias("_bytes")
        )
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_block", "_line", "_text"))), lambda x: x["_text"])
    across = (
        lines.where(head | tail)
        .groupBy("_file", F.when(head, F.col("_owner")).otherwise(F.col("_block")).alias("_start"), "_name")
        .agg(F.bool_or("_is_header").alias("_is_header"), F.array_join(parts, "\n").alias("_text"))
    )
    return inside.unionByName(across.drop("_file", "_start"))


class LayoutError(ValueError):
    """Files that are read together have different columns."""


def read_csv_records(
    spark: SparkSession, path: str, file_column: str | None = None, options: dict[str, str] | None = None
) -> DataFrame:
    """CSV with a header, every column as text; a quoted field may hold line breaks, and a file is read by many tasks.

    Quotes inside a field are doubled. ``options`` may name other ones of Spark's parser, not those of quotes or lines.
    ``file_column`` adds the name of a row's file. Files read together must have the same header. Blank lines between
    records are left out. A quote that is never closed makes one record of the rest of its file.
    """
    options = {"escape": '"'} | (options or {})
    lines = _lines(spark, path)
    splits = materialised(_splits(lines))
    if splits.where("_block = 0").select("_header").distinct().limit(2).count() > 1:
        starts = splits.where("_block = 0").select(*FILE, F.col("_first").alias("_line"))
        headers = lines.join(F.broadcast(starts), [*FILE, "_line"]).select(_without_return("_text")).distinct().limit(2)
        raise LayoutError(f"{path}: different headers {[row[0] for row in headers.collect()]}")
    # One row per split; lines keep the order in which they are read.
    placed = lines.join(F.broadcast(splits.drop("_header")), FILE).withColumn(
        "_is_header", (F.col("_block") == 0) & (F.col("_line") == F.col("_first"))
    )
    records = placed if splits.where("_odds > 0").isEmpty() else _whole_records(placed)
    columns = spark.read.options(**options).csv(path, header=True, multiLine=True).columns
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    text = _without_return("_text")
    parsed = records.where(~F.col("_is_header") & (F.trim(text) != "")).select(
        "_name", F.from_csv(text, schema, options).alias("_row")
    )
    return parsed.select("_row.*", *([F.col("_name").alias(file_column)] if file_column else []))
