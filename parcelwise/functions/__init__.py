from parcelwise.functions.columns import (
    bad_review,
    day,
    days_between,
    delay_bucket,
    delay_bucket_rank,
    late_peak,
    mean_of,
    month_start,
    ratio,
    share_true,
)

__all__ = [
    "bad_review",
    "day",
    "days_between",
    "delay_bucket",
    "delay_bucket_rank",
    "late_peak",
    "mean_of",
    "month_start",
    "ratio",
    "share_true",
]
