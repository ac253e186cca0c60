"""Column expressions shared by the plans. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Upper edges of the delay classes, in days.
DELAY_EDGES = (7, 14, 21, 30)

# Fixed value: a review of this score or lower is a bad one.
BAD_SCORE = 2


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day(c: Column | str) -> Column:
    """Calendar date of a zone-less timestamp. Lateness compares dates, never times."""
    return _column(c).cast("date")


def days_between(start: Column | str, end: Column | str) -> Column:
    """Whole calendar days from ``start`` to ``end``."""
    return F.datediff(day(end), day(start)).cast("long")


def month_start(c: Column | str) -> Column:
    return F.trunc(day(c), "month")


def _labels(edges: Sequence[int]) -> list[str]:
    lows = [0] + [edge + 1 for edge in edges]
    return [f"{low}-{high}" for low, high in zip(lows, edges)] + [f"{lows[-1]}+"]


def _first_class(days: Column, edges: Sequence[int], values: Sequence) -> Column:
    chosen = F.when(days <= edges[0], F.lit(values[0]))
    for edge, value in zip(edges[1:], values[1:-1]):
        chosen = chosen.when(days <= edge, F.lit(value))
    return chosen.otherwise(F.lit(values[-1]))


def delay_bucket(days: Column | str, edges: Sequence[int] = DELAY_EDGES) -> Column:
    """Label of the delay class, such as ``8-14``; everything beyond the last edge is one open class."""
    return _first_class(_column(days), edges, _labels(edges))


def delay_bucket_rank(days: Column | str, edges: Sequence[int] = DELAY_EDGES) -> Column:
    """Position of the delay class, for sorting labels in their natural order."""
    return _first_class(_column(days), edges, list(range(len(edges) + 1)))


def bad_review(score: Column | str = "review_score", worst: int = BAD_SCORE) -> Column:
    """True, false, or null when there is no review."""
    return _column(score) <= worst


def share_true(flag: Column | str, where: Column | None = None) -> Column:
    """Share of true among the non-null flags (of the rows where ``where`` is true)."""
    value = _column(flag).cast("int")
    return F.avg(value if where is None else F.when(where, value))


def mean_of(value: Column | str, where: Column | None = None) -> Column:
    value = _column(value)
    return F.avg(value if where is None else F.when(where, value))


def ratio(part: Column | str, whole: Column | str) -> Column:
    """Quotient of two totals as a double; null when the whole is zero."""
    return F.try_divide(_column(part).cast("double"), _column(whole).cast("double"))


def late_peak(rate: Column | str, order_by: str, at_least: float) -> Column:
    """A value of at least ``at_least`` that the next row does not exceed."""
    rate = _column(rate)
    following = F.lead(rate).over(Window.orderBy(F.col(order_by).asc_nulls_last()))
    return (rate >= at_least) & ~F.coalesce(following > rate, F.lit(False))
