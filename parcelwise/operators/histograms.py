"""Exact quantiles of small-domain values through counts.

Day counts take few distinct values, so rows are first counted per (group, value) in a plain hash aggregate
with map-side combine. The quantile then reads that histogram: its cost follows the number of distinct
values, and a group with a third of all rows is as cheap as any other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

# Interpolated quantiles differ between engines in the last bits; six decimals are far below one day.
QUANTILE_DIGITS = 6


def weighted_quantile(value: str, p: float, weight: str, frame: WindowSpec | None = None) -> Column:
    """Exact interpolated quantile of ``value`` repeated ``weight`` times, of a group or of a window frame."""
    quantile = F.percentile(value, p, F.col(weight))
    return F.round(quantile.over(frame) if frame else quantile, QUANTILE_DIGITS)


def whole_days(value: Column) -> Column:
    """Round a promise up to whole days."""
    return F.ceil(F.round(value, QUANTILE_DIGITS)).cast("double")
