"""Quality rules whose cutoffs come from labelled documents with a guarantee on false rejections.

Every rule rejects documents whose measure lies above a cutoff. The cutoffs of a rule form a fixed ladder from lenient
to strict. For each stratum and rule the strictest cutoff is taken that all labelled good documents of the
stratum support: the exact binomial test must show, for this cutoff and every more lenient one, that fewer than
``false_rejection / rules`` of the good documents are rejected. The level is divided by the number of
strata and rules (Bonferroni); along a ladder the tests run in a fixed sequence, which needs no further division. So with
probability ``1 - level`` no stratum loses more than ``false_rejection`` of its good documents to the rules.
A stratum with too few labels to show that has no cutoff.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.shared import arrow_map, with_columns
from parcelwise.session import materialised

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
FALSE_REJECTION = 0.04
LEVEL = 0.1


@dataclass(frozen=True)
class Rule:
    """A measure per document and its cutoffs from lenient to strict."""

    name: str
    value: str
    cutoffs: Sequence[float]


RULES = (
    Rule("symbols", "n_symbols / n_words", (8, 4, 3, 2, 1.5, 1, 0.8, 0.6, 0.4, 0.3, 0.2, 0.15, 0.1)),
    Rule("dup_lines", "n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2)),
    Rule("repeats", "n_repeat_words / n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    Rule("word_length", "word_chars / n_words", (40, 30, 25, 20, 18, 16, 14, 12)),
)

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: Sequence[bytes], window: int = 3) -> int:
    """Number of words inside a window of ``window`` words that occurs at least twice, its first place included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    code = ids[:n]
    for k in range(1, window):  # renumbered each time, so that codes stay small for any text
        code = np.unique(code, return_inverse=True)[1] if k > 1 else code
        code = code * len(number) + ids[k : n + k]
    _, place, count = np.unique(code, return_inverse=True, return_counts=True)
    again = count[place] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : n + k] |= again
    return int(covered.sum())


def measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The base measures of a text in the order of ``MEASURES``; a null text counts as empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def binomial_cdf(x: int, n: int, p: float) -> float:
    """P(X <= x) for n independent trials of probability p, by the incomplete beta function I_{1-p}(n - x, x + 1)."""
    if x < 0:
        return 0.0
    if x >= n:
        return 1.0
    a, b, z = n - x, x + 1, 1.0 - p
    if z < (a + 1) / (a + b + 2):
        return _beta_tail(a, b, z)
    return 1.0 - _beta_tail(b, a, p)


def _beta_tail(a: float, b: float, z: float) -> float:
    """Incomplete beta function by its continued fraction, evaluated from the front with Lentz's method."""
    tiny = 1e-300
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(z) + b * math.log1p(-z)
    ) / a
    c, d = 1.0, 1.0 / max(tiny, 1.0 - (a + b) * z / (a + 1))
    result = d
    for m in range(1, 100_000):
        for numerator in (
            m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / ((1.0 + numerator * d) or tiny)
            c = (1.0 + numerator / c) or tiny
            result *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return min(1.0, front * result)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` and a struct ``_quality`` of the base measures of its column ``text``."""

    def values(texts: list) -> dict:
        names = [part.split()[0] for part in MEASURES.split(", ")]
        return {"_quality": [dict(zip(names, measures(t), strict=True)) for t in texts]}

    return with_columns(docs, "text", f"_quality struct<{MEASURES.replace(' long', ': bigint')}>", values)


def base_failed() -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


def cutoffs(
    good: DataFrame,
    rules: Sequence[Rule] = RULES,
    false_rejection: float = FALSE_REJECTION,
    level: float = LEVEL,
) -> DataFrame:
    """Cutoffs per ``stratum``, one column ``cut_<rule>`` each, null where no cutoff is supported.

    ``good`` holds the stratum and the base measures of the labelled good documents that pass the base rules.
    """
    steps = F.array(
        *[
            F.struct(
                F.lit(i).alias("rule"),
                # The number of cutoffs that reject the document; stricter ones include more lenient ones.
                sum((F.expr(r.value) > F.lit(float(c))).cast("int") for c in r.cutoffs).alias("hits"),
            )
            for i, r in enumerate(rules)
        ]
    )
    counted = good.select("stratum", F.inline(steps)).groupBy("stratum", "rule", "hits").agg(F.count("*").alias("n"))
    counted = materialised(counted)
    strata = counted.select("stratum").distinct().count()
    share, each = false_rejection / len(rules), level / max(1, strata * len(rules))
    ladder = F.explode(
        F.expr("array(" + ", ".join(f"sequence(0, {len(r.cutoffs) - 1})" for r in rules) + ")[rule]")
    ).alias("step")
    tested = (
        counted.groupBy("stratum", "rule")
        .agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("hits", "n"))).alias("by_hits"))
        .select("stratum", "rule", "total", "by_hits", ladder)
        .withColumn("depth", F.expr("array(" + ", ".join(str(len(r.cutoffs)) for r in rules) + ")[rule]"))
        .selectExpr(
            "stratum",
            "rule",
            "step",
            "total",
            # Cutoff number `step` rejects what at least depth - step cutoffs reject.
            "cast(aggregate(map_values(map_filter(by_hits, (h, n) -> h >= depth - step)), 0L, (s, n) -> s + n) as long)"
            " as rejected",
        )
    )

    def decide(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            safe = [binomial_cdf(x, n, share) <= each for x, n in zip(b["rejected"], b["total"], strict=True)]
            yield {k: b[k] for k in ("stratum", "rule", "step")} | {"safe": safe}

    decided = arrow_map(tested, "stratum string, rule int, step int, safe boolean", decide)
    along = Window.partitionBy("stratum", "rule").orderBy("step")
    supported = decided.withColumn("all_safe", F.min("safe").over(along)).where("all_safe")
    strictest = supported.groupBy("stratum", "rule").agg(F.max("step").alias("step"))
    return strictest.groupBy("stratum").agg(
        *[
            F.max(F.when(F.col("rule") == i, F.array(*[F.lit(float(c)) for c in r.cutoffs])[F.col("step")])).alias(
                f"cut_{r.name}"
            )
            for i, r in enumerate(rules)
        ]
    )


def judged(
    docs: DataFrame,
    labels: DataFrame,
    stratum: Column | None = None,
    rules: Sequence[Rule] = RULES,
    false_rejection: float = FALSE_REJECTION,
    level: float = LEVEL,
) -> DataFrame:
    """``docs`` and a struct ``_quality``: the base measures, ``base_failed`` and ``kept``.

    ``labels`` has ``doc_id`` and ``quality``; a document is good if it has a label and no label below 1. The stratum is
    the language unless another column expression is given; null is a stratum of its own. A null text counts as
    empty and fails. Every row is judged by itself, so repeated ids, null ids and other columns do no harm. An
    empty table gives an empty result, empty labels leave the base rules alone.
    """
    stratum = F.coalesce((F.col("lang") if stratum is None else stratum).cast("string"), F.lit(""))
    rows = materialised(measured(docs).withColumn("_stratum", stratum))
    good_ids = labels.groupBy("doc_id").agg(F.min("quality").alias("least")).where("least >= 1").select("doc_id")
    flat = rows.select("doc_id", F.col("_stratum").alias("stratum"), "_quality.*").where(~base_failed())
    cuts = materialised(cutoffs(flat.join(good_ids, "doc_id", "left_semi"), rules, false_rejection, level))
    cuts = cuts.withColumnRenamed("stratum", "_cut_stratum")
    passes = F.lit(True)
    for rule in rules:
        value = F.expr(rule.value.replace("n_", "_quality.n_").replace("word_chars", "_quality.word_chars"))
        passes = passes & F.coalesce(value <= F.col(f"cut_{rule.name}"), F.lit(True))
    failed = F.expr(
        f"_quality.n_words < {MIN_WORDS} or 100 * _quality.n_repeat_words > {MAX_REPEAT_PERCENT} * _quality.n_words"
    )
    # One row per stratum: small, or else the join is shuffled and split by size.
    return rows.join(cuts, F.col("_stratum") == F.col("_cut_stratum"), "left").select(
        *docs.columns,
        F.struct("_quality.*", failed.alias("base_failed"), (~failed & passes).alias("kept")).alias("_quality"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    return judged(docs, labels).where("_quality.kept").select(*docs.columns)
