"""Ranked lexical search over impact vectors in norm buckets.

A document is a sparse vector of impacts, one whole number per term it shares with the queries; a query holds the weight of
each of its terms. With the square root of the weight on either side, their product is the score, and long vectors are the
ones that can score high. Documents are ordered by that length and cut into buckets; a query leaves out every bucket whose
longest vector cannot reach its tenth best score (Cauchy-Schwarz), and with it all later buckets of the slice. Inside a
bucket a few heavy coordinates are multiplied, and what the others can add at most is bounded by the lengths that are left.
Survivors are scored again in whole numbers, so results are exact.

Queries are taken in blocks of bounded size; each block is one pass over the documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parcelwise.llm.shared import arrow_map, prepared
from parcelwise.session import materialised

# Queries and bytes of their texts taken together, and bytes of a text looked at at a time.
ITEMS_PER_BLOCK = 2_000
BYTES_PER_BLOCK = 16 << 20
BYTES_PER_SLICE = 1 << 20

# Vectors of a bucket, and coordinates that are multiplied before the bound of the others is applied.
BUCKET = 4_096
FOCUS = 6

# One part in this many of the documents gives the scores that every slice starts from.
FIRST_PART = 64

# Floating bounds may come out lower than the exact product by rounding.
SLACK = 1 + 1e-9

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def term_counts(text: str | None) -> Counter:
    """Terms of a whole text with their counts, A-Z lower-cased."""
    raw = (text or "").encode().lower()
    counts: Counter = Counter()
    start = 0
    while start < len(raw):
        gap = _GAP.search(raw, min(start + BYTES_PER_SLICE, len(raw)))
        end = gap.start() if gap else len(raw)
        counts.update(_TERM.findall(raw, start, end))
        start = end
    return counts


VECTOR = "doc_id long, n long, terms array<int>, tf array<long>"


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Every document with its number of terms, and its counts of the terms of ``vocabulary``."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out = {"doc_id": batch["doc_id"], "n": [], "terms": [], "tf": []}
            for text in batch["text"]:
                counts = term_counts(text)
                shared = [(vocabulary[t], c) for t, c in counts.items() if t in vocabulary]
                out["n"].append(counts.total())
                out["terms"].append([t for t, _ in shared])
                out["tf"].append([c for _, c in shared])
            yield out

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), VECTOR, rows)


@dataclass(frozen=True)
class Corpus:
    """Number of documents with a term, number of their terms, and the weight of each term of the vocabulary."""

    documents: int
    terms: int
    weight: np.ndarray

    def impacts(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Impact of terms that occur ``tf`` times in documents of ``n`` terms."""
        m = 25 + (75 * n * self.documents) // max(self.terms, 1)
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def corpus(found: DataFrame, size: int) -> Corpus:
    """Statistics of the written vectors; at most ``size`` document frequencies come to the driver."""
    documents, terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(size, np.int64)
    for row in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        weight[row["term"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * row["df"] + 1)))
    return Corpus(documents, terms, weight)


def _with_length(found: DataFrame, stats: Corpus) -> DataFrame:
    """Vectors of impacts instead of counts, and their length with weighted coordinates."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            impacts, lengths = [], []
            for n, terms, tf in zip(batch["n"], batch["terms"], batch["tf"]):
                x = stats.impacts(np.int64(n), np.array(tf, np.int64))
                impacts.append(x.tolist())
                lengths.append(float(np.sqrt((x.astype(float) ** 2 * stats.weight[np.array(terms, np.int64)]).sum())))
            yield {"doc_id": batch["doc_id"], "terms": batch["terms"], "impacts": impacts, "length": lengths}

    return arrow_map(found.where("n > 0"), "doc_id long, terms array<int>, impacts array<long>, length double", rows)


class _Bucket:
    """Vectors of about the same length, by row and by term."""

    def __init__(self, ids: np.ndarray, missing: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, length: np.ndarray, weight: np.ndarray):
        self.ids, self.missing, self.length = ids, missing, length
        self.terms, self.impacts = terms, impacts
        self.starts = np.r_[0, np.cumsum(sizes)]
        owner = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(terms, kind="stable")
        self.by_term, self.owner = terms[order], owner[order]
        self.scaled = impacts[order] * np.sqrt(weight[self.by_term])

    def survivors(self, query: _Query, least: float) -> np.ndarray:
        """Rows that may reach ``least``: product over the heaviest coordinates, bound for all others."""
        product, used = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        low = np.searchsorted(self.by_term, query.focus, "left")
        high = np.searchsorted(self.by_term, query.focus, "right")
        for value, a, b in zip(query.focus_value, low, high):
            rows, x = self.owner[a:b], self.scaled[a:b]
            product[rows] += value * x
            used[rows] += x * x
        left = np.sqrt(np.maximum(self.length**2 * SLACK - used, 0))
        bound = (product + query.rest * left) * SLACK
        return np.nonzero((bound >= least) & (bound > 0))[0]

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact products of ``rows`` with a query's whole-number weights, given per term of the vocabulary."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        sums = np.r_[0, np.cumsum(weights[self.terms[place]] * self.impacts[place])]
        return sums[ends] - sums[ends - sizes]


class _Query:
    """Terms of one item and its best documents so far."""

    def __init__(self, counts: dict[int, int], weight: np.ndarray, top: int, least: int):
        self.terms = np.array(sorted(counts), np.int64)
        self.weights = np.array([counts[t] for t in self.terms.tolist()], np.int64) * weight[self.terms]
        value = np.array([counts[t] for t in self.terms.tolist()]) * np.sqrt(weight[self.terms])
        heavy = np.argsort(-value, kind="stable")
        self.focus, self.focus_value = self.terms[heavy[:FOCUS]], value[heavy[:FOCUS]]
        self.length = float(np.sqrt((value**2).sum()))
        self.rest = float(np.sqrt((value[heavy[FOCUS:]] ** 2).sum()))
        self.top, self.least, self.done = top, max(least, 1), False
        self.score, self.ids, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        good = score >= self.least
        score, ids, missing = np.r_[self.score, score[good]], np.r_[self.ids, ids[good]], np.r_[self.missing, missing[good]]
        best = np.lexsort((ids, missing, -score))[: self.top]
        self.score, self.ids, self.missing = score[best], ids[best], missing[best]
        if len(best) == self.top:
            self.least = max(self.least, int(self.score[-1]))


def _search(batches: Iterator[pa.RecordBatch], queries: list[_Query], weight: np.ndarray) -> None:
    """Run the queries over vectors that arrive by descending length."""
    dense = np.zeros(len(weight), np.int64)
    held: list[pa.RecordBatch] = []

    def bucket() -> None:
        whole = pa.concat_batches(held)
        ids, lists = whole.column(0), whole.column(1)
        found = _Bucket(
            ids.fill_null(0).to_numpy(),
            ids.is_null().to_numpy(zero_copy_only=False),
            np.diff(lists.offsets.to_numpy()),
            lists.flatten().to_numpy().astype(np.int64),
            whole.column(2).flatten().to_numpy(),
            whole.column(3).to_numpy(),
            weight,
        )
        longest = found.length.max()
        for query in queries:
            # Later vectors are no longer than these.
            query.done = query.done or query.length * longest * SLACK < query.least
            if query.done:
                continue
            rows = found.survivors(query, query.least)
            if len(rows):
                dense[query.terms] = query.weights
                query.add(found.scores(rows, dense), found.ids[rows], found.missing[rows])
                dense[query.terms] = 0

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BUCKET:
            bucket()
            held.clear()
        if all(q.done for q in queries):
            for _ in batches:  # the reader on the other side expects to be read to the end
                pass
            return
    if held:
        bucket()


def _best(placed: DataFrame, items: list[dict[int, int]], stats: Corpus, top: int, least: list[int]) -> DataFrame:
    """``item`` (place in ``items``), ``doc_id``, ``score``: the best of each partition, equal scores by id."""
    schema = StructType.fromDDL("item int, doc_id long, score long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [_Query(counts, stats.weight, top, low) for counts, low in zip(items, least)]
        _search(batches, queries, stats.weight)
        for i, query in enumerate(queries):
            if len(query.score):
                ids = [None if gone else d for d, gone in zip(query.ids.tolist(), query.missing)]
                rows = {"item": [i] * len(ids), "doc_id": ids, "score": query.score}
                yield pa.RecordBatch.from_pydict(rows, schema=arrow)

    found = placed.select("doc_id", "terms", "impacts", "length").mapInArrow(run, schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _block(docs: DataFrame, texts: list[str | None], top: int) -> DataFrame:
    """The best documents of one block of queries; ``item`` is the place in ``texts``."""
    counted = [term_counts(text) for text in texts]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
    items = [{vocabulary[t]: c for t, c in counts.items()} for counts in counted]
    found = materialised(vectors(docs, vocabulary))
    stats = corpus(found, len(vocabulary))
    measured = materialised(_with_length(found, stats))
    # The tenth best score within a part of the documents bounds that of all from below.
    part = measured.where(F.pmod(F.xxhash64("doc_id", "length"), F.lit(FIRST_PART)) == 0)
    least = [0] * len(items)
    for row in _best(part.sortWithinPartitions(F.desc("length")), items, stats, top, least).where(F.col("rank") == top).collect():
        least[row["item"]] = row["score"]
    # Copies have equal lengths; the hash lets range partitions cut between them.
    order = [F.desc("length"), F.xxhash64("doc_id").asc()]
    return _best(measured.repartitionByRange(*order).sortWithinPartitions(*order), items, stats, top, least)


def search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` best documents for every item: ``item_id``, ``rank``, ``doc_id``, ``score``.

    ``docs`` needs ``doc_id`` (whole numbers) and ``text``, ``items`` needs ``item_id`` and ``text``; other columns are ignored,
    whatever their names. Null and empty texts have no terms: such documents are never found, such items find nothing, as do
    items whose terms no document holds. Repeated documents and items all count, each with a rank of its own; equal scores go
    by ``doc_id``, nulls last. Empty tables give no rows.
    """
    spark = prepared(docs.sparkSession)
    numbered = materialised(items.select("item_id", "text").withColumn("_place", F.monotonically_increasing_id()))
    rows, size = numbered.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-rows // ITEMS_PER_BLOCK), -(-size // BYTES_PER_BLOCK))
    result = None
    for number in range(blocks):
        block = numbered.where(F.pmod(F.xxhash64("_place"), F.lit(blocks)) == number).orderBy("_place").collect()
        if not block:
            continue
        names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(block)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        best = _block(docs, [row["text"] for row in block], top).join(F.broadcast(names), "item")  # a block's items
        best = best.select("item_id", "rank", "doc_id", "score")
        result = best if result is None else result.unionByName(best)
    if result is None:
        schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
        return spark.createDataFrame([], schema)
    return result
