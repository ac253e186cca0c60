"""Results as a long metrics table, and checks of published figures against it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.functions.entities import decoded_entities
from parcelwise.functions import ratio
from parcelwise.plans.quality import one_row

METRIC_KEY = ["section", "key", "ordinal", "metric"]


def metric_rows(
    result: DataFrame, section: str, key: Column | None = None, order: Sequence[Column] | None = None
) -> DataFrame:
    """A result as rows (section, key, ordinal, metric, value, text).

    Results of one row have no key and no ordinal. A report list is numbered from 0 along ``order``; such a
    list is a published table (months, routes, margins), never a per-order or per-person result.
    """
    numbered = result
    if order is None:
        ordinal = F.lit(None).cast("long")
    else:
        numbered = result.withColumn("_ordinal", F.row_number().over(Window.orderBy(*order)) - 1)
        ordinal = F.col("_ordinal").cast("long")

    def entry(field: T.StructField) -> Column:
        numeric = isinstance(field.dataType, T.NumericType)
        nothing = F.lit(None)
        return F.struct(
            F.lit(field.name).alias("metric"),
            (F.col(field.name).cast("double") if numeric else nothing.cast("double")).alias("value"),
            (nothing.cast("string") if numeric else F.col(field.name).cast("string")).alias("text"),
        )

    return numbered.select(
        F.lit(section).alias("section"),
        (F.lit(None).cast("string") if key is None else key.cast("string")).alias("key"),
        ordinal.alias("ordinal"),
        F.inline(F.array(*[entry(field) for field in result.schema.fields])),
    )


def dated(metrics: DataFrame, generated_on: dt.date, published_on: dt.date) -> DataFrame:
    """``metrics`` with both dates as figures without a section."""
    dates = [("generated_on", generated_on.isoformat()), ("published_on", published_on.isoformat())]
    entries = [F.struct(F.lit(name).alias("metric"), F.lit(text).alias("text")) for name, text in dates]
    rows = metrics.sparkSession.range(1).select(F.inline(F.array(*entries)))
    nothing = F.lit(None)
    return metrics.unionByName(
        rows.select(
            nothing.cast("string").alias("section"),
            nothing.cast("string").alias("key"),
            nothing.cast("long").alias("ordinal"),
            "metric",
            nothing.cast("double").alias("value"),
            "text",
        )
    )


def metric_paths(metrics: DataFrame) -> DataFrame:
    """Dotted path per metric (``section.metric`` or ``section.ordinal.metric``) plus ``section.length``."""
    paths = metrics.select(
        F.concat_ws(".", "section", F.col("ordinal").cast("string"), "metric").alias("path"), "value", "text"
    )
    lengths = (
        metrics.where(F.col("ordinal").isNotNull())
        .groupBy("section")
        .agg(F.count_distinct("ordinal").cast("double").alias("value"))
        .select(
            F.concat_ws(".", "section", F.lit("length")).alias("path"), "value", F.lit(None).cast("string").alias("text")
        )
    )
    return paths.unionByName(lengths)


def write_metrics(metrics: DataFrame, path: str, file_format: str = "parquet") -> None:
    metrics.write.mode("overwrite").format(file_format).save(path)


def metrics_snapshot_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """Figures that changed, appeared or vanished between two runs."""
    left = new.select(
        *METRIC_KEY, F.col("value").alias("new_value"), F.col("text").alias("new_text"), F.lit(True).alias("_new")
    )
    right = old.select(
        *[F.col(c).alias(f"_{c}") for c in METRIC_KEY],
        F.col("value").alias("old_value"),
        F.col("text").alias("old_text"),
        F.lit(True).alias("_old"),
    )
    same_key = F.lit(True)
    for column in METRIC_KEY:
        same_key = same_key & F.col(column).eqNullSafe(F.col(f"_{column}"))
    unchanged = F.col("new_value").eqNullSafe(F.col("old_value")) & F.col("new_text").eqNullSafe(F.col("old_text"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~unchanged, "changed")
    return (
        left.join(right, same_key, "full")
        .withColumn("change", change)
        .where(F.col("change").isNotNull())
        .select(
            *[
                F.when(F.col("_new").isNull(), F.col(f"_{column}")).otherwise(F.col(column)).alias(column)
                for column in METRIC_KEY
            ],
            "change",
            "old_value",
            "new_value",
            "old_text",
            "new_text",
        )
    )


def publication_date(diff: DataFrame, previous: dt.date | None, today: dt.date) -> DataFrame:
    """One row: the previous date while no figure changed, otherwise today."""
    changed = diff.agg(F.count(F.lit(1)).alias("changed_figures"))
    if previous is None:
        return changed.select("changed_figures", F.lit(today).alias("generated_on"))
    stamp = F.when(F.col("changed_figures") > 0, F.lit(today)).otherwise(F.lit(previous))
    return changed.select("changed_figures", stamp.alias("generated_on"))


def derived_figures(
    delay: DataFrame,
    timing: DataFrame,
    handovers: DataFrame,
    concentration: DataFrame,
    excess: DataFrame,
    policy: DataFrame,
    bucket: str = "15-21",
    min_late_orders: int = 100,
    compat_rounding: bool = False,
) -> DataFrame:
    """One row of shares and differences over earlier results.

    ``policy`` is the evaluated rule cited in the text. Its avoided bad reviews are the difference of two counts that
    are published as whole numbers, so these are rounded first; all other figures come from unrounded ones. The
    ratio of late to on-time bad-review rate covers the delay classes with enough late orders. Each result is read
    once, as one struct. With ``compat_rounding`` every figure is made of rates and days as they are published, already
    rounded, and rounded again.
    """

    def shown(value: Column, digits: int) -> Column:
        return F.round(value, digits) if compat_rounding else value

    delay = delay.withColumn("bad_rate", shown(F.col("bad_rate"), 4))
    excess = excess.withColumn("excess_late", shown(F.col("excess_late"), 0))
    for name, digits in (("new_promise", 2), ("old_promise", 2), ("new_late_rate", 4), ("old_late_rate", 4)):
        policy = policy.withColumn(name, shown(F.col(name), digits))
    late = F.col("is_late")
    by_class = delay.groupBy("bucket").agg(
        F.max(F.when(late, F.col("bad_rate"))).alias("late_rate"),
        F.max(F.when(~late, F.col("bad_rate"))).alias("on_time_rate"),
        F.max(F.when(late, F.col("orders"))).alias("late_orders"),
    )
    times = F.when(F.col("late_orders") >= min_late_orders, ratio("late_rate", "on_time_rate"))
    chosen = F.col("bucket") == bucket
    classes = by_class.agg(
        F.struct(
            F.min(times).alias("lowest"),
            F.max(times).alias("highest"),
            F.max(F.when(chosen, F.col("on_time_rate"))).alias("on_time"),
            F.max(F.when(chosen, F.col("late_rate"))).alias("late"),
        )
    )
    old_bad, new_bad = F.round("old_bad_reviews"), F.round("new_bad_reviews")
    cited = F.struct(
        (F.col("new_promise") - F.col("old_promise")).alias("days"),
        (old_bad - new_bad).alias("bad"),
        F.try_divide(old_bad - new_bad, old_bad).alias("bad_share"),
        (F.lit(1.0) - F.try_divide("new_late_rate", "old_late_rate")).alias("late_share"),
    )
    return one_row(
        delay.sparkSession,
        _classes=classes,
        _policy=policy.select(cited),
        late_share_seller_on_time=handovers.select(ratio("late_with_seller_on_time", "late_orders")),
        bad_share_before_delivery=timing.select(ratio("bad_before_delivery", "bad")),
        _excess=excess.select("excess_late"),
        _late=concentration.select("late_orders"),
    ).select(
        shown(F.col("_classes.lowest"), 1).alias("late_vs_on_time_ratio_min"),
        shown(F.col("_classes.highest"), 1).alias("late_vs_on_time_ratio_max"),
        shown(F.col("late_share_seller_on_time"), 4).alias("late_share_seller_on_time"),
        shown(F.col("bad_share_before_delivery"), 4).alias("bad_share_before_delivery"),
        F.col("_classes.on_time").alias("bad_in_bucket_on_time"),
        F.col("_classes.late").alias("bad_in_bucket_late"),
        shown(F.col("_policy.days"), 2).alias("policy_extra_days"),
        F.col("_policy.bad").alias("policy_bad_avoided"),
        shown(F.col("_policy.bad_share"), 4).alias("policy_bad_avoided_share"),
        shown(F.col("_policy.late_share"), 4).alias("policy_late_avoided_share"),
        shown(ratio("_excess", "_late"), 4).alias("excess_late_share"),
    )


def cited_margin_mismatch(grid: DataFrame, policy: DataFrame, margin: int) -> DataFrame:
    """Figures in which the cited rule differs from the grid's row of the same margin: no rows if all is well."""
    names = ("new_promise", "new_late_rate", "new_bad_reviews")
    row = grid.where(F.col("margin") == margin).agg(*[F.max(n).alias(f"grid_{n}") for n in names])
    both = policy.select(*names).join(row, F.lit(True), "left")
    pairs = [
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("cited"), F.col(f"grid_{n}").alias("in_grid")) for n in names
    ]
    return both.select(F.inline(F.array(*pairs))).where(
        "in_grid is null or cited is null or abs(cited - in_grid) > 1e-9"
    )


# How a published figure is marked in the page, and the mark of an update notice.
FIGURE_PATTERN = r'data-k="([^"]+)" data-f="([^"]+)">([^<]*)<'
UPDATE_MARK = 'class="updated"'

# Format code -> (scale, decimals) of a published number.
NUMBER_FORMATS = {
    "int": (1, 0),
    "n0": (1, 0),
    "n1": (1, 1),
    "n2": (1, 2),
    "pct": (100, 1),
    "pct0": (100, 0),
    "pct2": (100, 2),
}

# Month names of published dates.
MONTH_NAMES = [
    "janvier",
    "février",
    "mars",
    "avril",
    "mai",
    "juin",
    "juillet",
    "août",
    "septembre",
    "octobre",
    "novembre",
    "décembre",
]


# Keys of published pages whose figures have another name here.
PAGE_KEYS = {
    "derived.bad_15_21_on_time": "derived.bad_in_bucket_on_time",
    "derived.bad_15_21_late": "derived.bad_in_bucket_late",
    "derived.risky_plus5_extra_days": "derived.policy_extra_days",
    "derived.risky_plus5_bad_avoided": "derived.policy_bad_avoided",
    "derived.risky_plus5_bad_avoided_share": "derived.policy_bad_avoided_share",
    "derived.risky_plus5_late_avoided_share": "derived.policy_late_avoided_share",
    "backtest.policies.2.march_late_rate": "backtest.policies.2.focus_late_rate",
}
# Pages name the promise that was really made after who made it.
MADE_PROMISE = r"^(backtest\.policies\.\d+)\.(?!new_|focus_|old_)[a-z]+_(promise|late_rate|bad_reviews)$"


def _metric_key(key: Column) -> Column:
    """The path of the metric that a page's key means."""
    names = F.create_map(*[F.lit(x) for pair in PAGE_KEYS.items() for x in pair])
    return F.coalesce(F.element_at(names, key), F.regexp_replace(key, MADE_PROMISE, "$1.old_$2"))


def published_figures(pages: DataFrame) -> DataFrame:
    """Every marked figure of every page (page, html): page, key, format, shown text."""
    found = [F.regexp_extract_all("html", F.lit(FIGURE_PATTERN), F.lit(group)) for group in (1, 2, 3)]
    return pages.select("page", F.explode(F.arrays_zip(*[c.alias(n) for c, n in zip(found, "kfs")])).alias("_f")).select(
        "page", F.col("_f.k").alias("key"), F.col("_f.f").alias("format"), F.col("_f.s").alias("shown")
    )


def plain_text(shown: Column) -> Column:
    """Character references resolved, every run of space as one blank, the typographic minus as a hyphen."""
    text = F.regexp_replace(decoded_entities(shown), "\u2212", "-")
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x{00A0}\x{202F}]+", " "))


def _shown_number(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[ %]", ""), ",", ".").try_cast("double")


def _shown_date(text: Column) -> Column:
    parts = F.split(text, " ")
    month = F.array_position(F.array(*[F.lit(name) for name in MONTH_NAMES]), F.get(parts, F.lit(1)))
    iso = F.format_string(
        "%s-%02d-%02d", F.get(parts, F.lit(2)), month.cast("int"), F.get(parts, F.lit(0)).try_cast("int")
    )
    return F.when(F.size(parts) == 3, iso.try_cast("date"))


def reconcile_published(pages: DataFrame, metrics: DataFrame) -> DataFrame:
    """Published figures that the metrics do not confirm at the precision shown.

    Numbers are compared as numbers: a figure is right when it lies within half a unit of its last decimal.
    A key without a metric and an unknown format are reported too.
    """
    known = metric_paths(metrics).select(
        F.col("path").alias("_path"),
        F.col("value").alias("expected"),
        F.col("text").alias("expected_text"),
        F.lit(True).alias("_known"),
    )
    text = plain_text(F.col("shown"))
    scale, half_unit = F.lit(None).cast("double"), F.lit(None).cast("double")
    for code, (factor, decimals) in NUMBER_FORMATS.items():
        scale = F.when(F.col("format") == code, F.lit(float(factor))).otherwise(scale)
        half_unit = F.when(F.col("format") == code, F.lit(0.5 * 10.0**-decimals)).otherwise(half_unit)
    right_number = F.abs(_shown_number(text) - F.col("expected") * scale) <= half_unit + 1e-9
    right_date = _shown_date(text) == F.col("expected_text").try_cast("date")
    is_date = F.col("format") == "date"
    problem = (
        F.when(F.col("_known").isNull(), "unknown key")
        .when(~is_date & scale.isNull(), "unknown format")
        .when(~F.coalesce(F.when(is_date, right_date).otherwise(right_number), F.lit(False)), "differs")
    )
    return (
        published_figures(pages)
        .join(known, _metric_key(F.col("key")) == F.col("_path"), "left")
        .withColumn("problem", problem)
        .where(F.col("problem").isNotNull())
        .select("page", "key", "format", "shown", "expected", "expected_text", "problem")
    )


def update_notice_mismatch(pages: DataFrame, generated_on: dt.date, published_on: dt.date) -> DataFrame:
    """Pages that show an update notice although no figure changed since publication, or lack one."""
    due = generated_on != published_on
    return (
        pages.select("page", F.contains("html", F.lit(UPDATE_MARK)).alias("has_notice"))
        .withColumn("notice_due", F.lit(due))
        .where(F.col("has_notice") != F.col("notice_due"))
    )
