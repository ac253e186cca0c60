"""From raw documents to tokens: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes the rows the one before has kept, as they were written. All but the last return the columns of the
documents table; the last returns a row of tokens per document with its place in the mix.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import bpe, line_dedup, mixing, quality_rules, simhash
from parcelwise.llm.queries import TOKENIZER, WEIGHTS
from parcelwise.llm.shared import prepared, table
from parcelwise.session import collected, materialised, remove

# Tables that stages have written on the way; once a stage's rows are written, the next one deletes them.
_spent: list[str] = []


def stage(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that drops what the one before has left behind, and leaves its own for the next."""

    @wraps(build)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _spent)
        with collected() as places:
            kept = build(spark, docs, sf_dir)
        _spent.extend(places)
        return kept

    return staged


@stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the cutoffs come from the labelled ones among them."""
    return quality_rules.accepted(docs, table(spark, sf_dir, "labels"))


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere, word for word or nearly so."""
    prepared(spark)
    return line_dedup.deduplicated(docs).select(*docs.columns)


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepared(spark)
    return simhash.one_per_component(docs, words=3, max_bits=3)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix, which its plan tells the next stage."""
    prepared(spark)
    return mixing.mixed(docs, WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document: ``doc_id``, ``slot``, ``position``, ``ids``, ``n_tokens``, digest of the decoded text.

    What it writes on the way stays, since its own rows are read last of all.
    Files keep no order of rows, so places follow from the plan of the mix; documents that were not mixed have none.
    """
    prepared(spark)
    remove(spark, _spent)
    texts = docs.select("doc_id", "text", "source")
    if plan := mixing.planned(docs):
        placed = mixing.placed(texts, plan).select("doc_id", "text", "_mix.slot", "_mix.position")
    else:
        none = F.lit(None).cast("long")
        placed = texts.select("doc_id", "text", none.alias("slot"), none.alias("position"))
    tokens = bpe.encoded(placed, TOKENIZER, ["slot", "position"])
    return tokens.select(
        "doc_id",
        "slot",
        "position",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_lines),
    ("near-dedup", drop_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

# Fingerprints, edit similarity of linked lines and tokens have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, run_stage in STAGES[:-1]:
        docs = materialised(run_stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
