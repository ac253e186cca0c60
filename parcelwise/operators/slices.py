"""Order-dependent computations over groups too large for one task.

All rows are range-partitioned on the full sort order, sorted and written once with their row numbers. A partition
is a slice: a run of consecutive rows, whatever keys they have. Only keys that a slice edge cuts, two per slice at
most, need anything from other slices; that is a table with a few rows per slice, joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.session import materialised

# The upper bits of a row number are the partition it was written by.
ROW_BITS = 33


def range_slices(df: DataFrame, order: Sequence[Column], slices: int | None = None) -> DataFrame:
    """``df`` with ``_row``, ascending along ``order``, and ``_slice``, the range partition.

    Without ``slices`` the session's number of shuffle partitions counts, as for any other exchange.
    """
    ranged = df.repartitionByRange(*([slices] if slices else []), *order).sortWithinPartitions(*order)
    written = materialised(ranged.withColumn("_row", F.monotonically_increasing_id()))
    return written.withColumn("_slice", F.shiftright("_row", ROW_BITS))


def running_totals(
    df: DataFrame, order: Sequence[Column], totals: Mapping[str, str], rank: str, slices: int | None = None
) -> DataFrame:
    """Running sums and row number over the whole table, in the given order.

    ``totals`` maps the new column to the column it sums. The result also carries ``<new>_all``, the grand
    total. Only one row per slice passes through a single task.
    """
    sliced = range_slices(df, order, slices)
    per_slice = sliced.groupBy("_slice").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(source).alias(f"_{new}") for new, source in totals.items()]
    )
    whole = Window.orderBy("_slice")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per_slice.select(
        "_slice",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        *[F.coalesce(F.sum(f"_{new}").over(before), F.lit(0)).alias(f"_{new}_before") for new in totals],
        *[F.sum(f"_{new}").over(every).alias(f"{new}_all") for new in totals],
    )
    inside = Window.partitionBy("_slice").orderBy("_row")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sliced.join(offsets, "_slice").select(
        *df.columns,
        (F.col("_rows_before") + F.row_number().over(inside)).alias(rank),
        *[
            (F.col(f"_{new}_before") + F.coalesce(F.sum(source).over(so_far), F.lit(0))).alias(new)
            for new, source in totals.items()
        ],
        *[F.col(f"{new}_all") for new in totals],
    )


def _cut_keys(sliced: DataFrame, key: str, following: str) -> DataFrame:
    """Rows before a slice, and first value after it, of the keys that have rows in several slices."""
    edges = sliced.groupBy("_slice").agg(
        F.min_by(F.struct(key), "_row").alias("_first"), F.max_by(F.struct(key), "_row").alias("_last")
    )
    along = Window.orderBy("_slice")
    cut = edges.select(
        "_slice",
        F.when(F.lag("_last").over(along).eqNullSafe(F.col("_first")), F.col("_first")).alias("_from"),
        F.when(F.lead("_first").over(along).eqNullSafe(F.col("_last")), F.col("_last")).alias("_to"),
    )
    own = F.struct(key)
    pieces = (
        sliced.join(cut.where("_from is not null or _to is not null"), "_slice")
        .where(own.eqNullSafe(F.col("_from")) | own.eqNullSafe(F.col("_to")))
        .groupBy("_slice", key)
        .agg(F.count(F.lit(1)).alias("_rows"), F.min_by(following, "_row").alias("_first_value"))
    )
    per_key = Window.partitionBy(key).orderBy("_slice")
    return pieces.select(
        F.col(key).alias("_key"),
        F.col("_slice").alias("_piece"),
        F.coalesce(F.sum("_rows").over(per_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lead("_first_value").over(per_key).alias("_next_first"),
    )


def ranked_sequence(
    df: DataFrame, key: str, order: Sequence[str], rank: str, following: str, slices: int | None = None
) -> DataFrame:
    """Row number per ``key`` in ``order`` (nulls last) and the next row's value of the first order column.

    One plan for all keys: each is ranked inside its slices, and the few that slice edges cut are corrected. So no
    task holds more than a slice, however many rows a key has. ``order`` must be unique within a key.
    """
    in_order = [F.col(c).asc_nulls_last() for c in order]
    sliced = range_slices(df, [F.col(key).asc_nulls_last(), *in_order], slices)
    inside = Window.partitionBy(key, "_slice").orderBy("_row")
    corrected = sliced.join(
        _cut_keys(sliced, key, order[0]),
        (F.col("_slice") == F.col("_piece")) & F.col(key).eqNullSafe(F.col("_key")),
        "left",
    )
    # A value of the first order column may be null, so a missing next row shows in the next row's number.
    has_next = F.lead("_row").over(inside).isNotNull()
    return corrected.select(
        *df.columns,
        (F.coalesce("_before", F.lit(0)) + F.row_number().over(inside)).cast("long").alias(rank),
        F.when(has_next, F.lead(order[0]).over(inside)).otherwise(F.col("_next_first")).alias(following),
    )
