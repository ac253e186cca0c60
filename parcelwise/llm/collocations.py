"""Collocations by stripes: phrases whose words keep company far more often than they stand apart.

Every word keys a stripe, an associative counter of what follows it: the next words up to the longest phrase, or fewer
where the piece ends. Tasks count the stripes of a million words at a time, stripes of one word are merged entry by entry
after one shuffle, and a merged stripe tells everything at once: the word's own count and the counts of all phrases that
start with it are sums over its entries. Phrases below the least count end there; what is left decides on parts and on
longer phrases.

Stripes of very frequent words are cut into shards by the second word, and again by the whole entry where a pair of words
is as frequent, so no task holds more than a bounded share of the text; partial sums of shards are added up after the merge.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parcelwise.llm.shared import prepared
from parcelwise.session import materialised

# Words counted together in a task before their stripes leave it, and bytes of a text looked at at a time.
WORDS_PER_RUN = 1_000_000
BYTES_PER_SLICE = 1 << 20

# Occurrences a shard of a stripe is meant for, and the number of words (and of pairs) whose stripes may be cut: a stripe is
# if it has more than SHARD occurrences and more than 1 / CUT of all words, so there are fewer than CUT of either.
SHARD = 200_000
CUT = 20_000

# Entries merged together in a task.
ENTRIES_PER_MERGE = 300_000

BREAK = b"."
_TO_BREAKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", BREAK * 9 + b" ")
_EDGE = re.compile(rb"[.,;:!?\n\x0b\x0c\r\t ]")


def _tokens(text: str | None) -> Iterator[list[bytes]]:
    """Words of ``text`` with A-Z lower-cased and a break after each piece, in slices; the last slice ends with a break."""
    raw = (text or "").encode()
    start = 0
    while start < len(raw):
        edge = _EDGE.search(raw, min(start + BYTES_PER_SLICE, len(raw)))
        end = edge.start() if edge else len(raw)
        yield raw[start:end].lower().translate(_TO_BREAKS).replace(BREAK, b" . ").split()
        start = end
    yield [BREAK]


def _runs(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[tuple[str, list[bytes], int]]:
    """(language, words, number of words to count) of the (lang, text) rows; the words behind that number are context.

    The context of a run opens the language's next run, so phrases across slices and runs are counted once.
    """
    held: dict[str, list[bytes]] = {}
    size = 0

    def out(last: bool) -> Iterator[tuple[str, list[bytes], int]]:
        for lang, words in held.items():
            if last:
                words.extend([BREAK] * overlap)
            if (counted := len(words) - overlap) > 0:
                yield lang, words, counted
                held[lang] = words[counted:]

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for words in _tokens(text):
                held.setdefault(lang, []).extend(words)
                size += len(words)
                if size >= WORDS_PER_RUN:
                    yield from out(last=False)
                    size = sum(map(len, held.values()))
    yield from out(last=True)


def _numbered(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, and the word of each number; the break is number 0, wherever it occurs."""
    ids, found = pd.factorize(np.array([BREAK, *words], object))
    return ids[1:].astype(np.int64), found


def _heads(lang: str, words: list[bytes], counted: int) -> dict[str, list]:
    """Hashes of the words and pairs of words that have a noticeable share of a run, with their counts."""
    ids, found = _numbered(words)
    size = len(found)
    n = np.bincount(ids[:counted], minlength=size)
    often = [i for i in np.nonzero(n * CUT >= counted)[0] if i]
    follower = ids[1 : counted + 1]
    both = (ids[:counted] > 0) & (follower > 0)
    pair, times = np.unique(ids[:counted][both] * size + follower[both], return_counts=True)
    pair, times = pair[times * CUT >= counted], times[times * CUT >= counted]
    return {
        "lang": [lang] * (len(often) + len(pair)),
        "words": [1] * len(often) + [2] * len(pair),
        "head": [zlib.crc32(found[i]) for i in often] + [zlib.crc32(found[k // size] + b" " + found[k % size]) for k in pair],
        "n": np.r_[n[often], times].astype(np.int64),
    }


def _shards(texts: DataFrame, size: int) -> dict[tuple[str, int], int]:
    """(language, hash of a word or pair) -> number of shards, for the stripes that are cut: fewer than 2 * ``CUT``.

    Runs leave out what is below 1 / ``CUT`` of the run, which only matters for words near that share of all.
    """
    schema = StructType.fromDDL("lang string, words int, head long, n long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in _runs(batches, 1):
            yield pa.RecordBatch.from_pydict(_heads(*full), schema=arrow)

    counted = materialised(texts.mapInArrow(run, schema).groupBy("lang", "words", "head").agg(F.sum("n").alias("n")))
    everything = counted.where("words = 1").agg(F.sum("n")).first()[0] or 0
    cut = counted.where((F.col("n") > size) & (F.col("n") * CUT > everything))
    return {(row["lang"], row["head"]): -(-row["n"] // size) for row in cut.collect()}


def _shard(lang: str, found: np.ndarray, first: np.ndarray, second: np.ndarray, entries: pa.Array, shards: dict) -> np.ndarray:
    """Shard of each entry: 0 if its stripe is whole, above 0 by the second word, below 0 by the whole entry of a cut pair."""
    crc = np.fromiter(map(zlib.crc32, found), np.int64, len(found))
    parts = np.array([shards.get((lang, c), 1) for c in crc.tolist()])
    shard = np.where(parts[first] > 1, 1 + crc[second] % parts[first], 0)
    # A pair is no more frequent than either of its words.
    often = np.nonzero((parts[first] > 1) & (parts[second] > 1) & (second > 0))[0]
    pair, place = np.unique(first[often] * len(found) + second[often], return_inverse=True)
    words = [found[k // len(found)] + b" " + found[k % len(found)] for k in pair.tolist()]
    pieces = np.array([shards.get((lang, zlib.crc32(w)), 1) for w in words], np.int64)[place]
    for i, n in zip(often[pieces > 1].tolist(), pieces[pieces > 1].tolist()):
        shard[i] = -1 - zlib.crc32(entries[i].as_py().encode()) % n
    return shard


STRIPES = "lang string, word string, shard int, entries array<string>, counts array<long>"


def _joined(parts: list[pa.Array]) -> pa.Array:
    """Words of an entry with a blank between them; words behind a piece's end are missing and leave nothing."""
    # Rows with nothing but nulls would be left out, and where the first word is missing, the others are.
    return pc.binary_join_element_wise(parts[0].fill_null(""), *parts[1:], " ", null_handling="skip")


def _stripes(lang: str, words: list[bytes], counted: int, longest: int, shards: dict, arrow: pa.Schema) -> pa.RecordBatch:
    """The stripes of a run of words."""
    ids, found = _numbered(words)
    at = np.nonzero(ids[:counted])[0]
    columns, open_ = [ids[at]], np.ones(len(at), bool)
    for step in range(1, longest):
        follower = ids[at + step]
        open_ &= follower != 0
        columns.append(np.where(open_, follower, 0))
    # One number per occurrence where it fits, as it does for three words; otherwise rows are compared.
    if len(found) ** longest < 2**62:
        key = columns[0]
        for column in columns[1:]:
            key = key * len(found) + column
        _, first, n = np.unique(key, return_index=True, return_counts=True)
    else:
        _, first, n = np.unique(np.stack(columns, 1), axis=0, return_index=True, return_counts=True)
    head = columns[0][first]
    text = pa.array(found, pa.binary()).cast(pa.string())
    entries = _joined([text.take(pa.array(c[first], mask=c[first] == 0)) for c in columns[1:]])
    shard = np.zeros(len(head), np.int64)
    if shards and len(head):
        shard = _shard(lang, found, head, columns[1][first], entries, shards)
        order = np.lexsort((shard, head))
        head, shard, entries, n = head[order], shard[order], entries.take(pa.array(order)), n[order]
    starts = np.nonzero(np.r_[True, (head[1:] != head[:-1]) | (shard[1:] != shard[:-1])])[0] if len(head) else head
    offsets = pa.array(np.r_[starts, len(head)], pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * len(starts), pa.string()),
            text.take(pa.array(head[starts])),
            pa.array(shard[starts], pa.int32()),
            pa.ListArray.from_arrays(offsets, entries, type=arrow.field("entries").type),
            pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64()), type=arrow.field("counts").type),
        ],
        schema=arrow,
    )


def stripes(texts: DataFrame, longest: int, shard_size: int = SHARD) -> DataFrame:
    """Partial stripes of ``texts`` (``lang``, ``text``), one per word, shard and run."""
    shards = _shards(texts, shard_size)
    schema = StructType.fromDDL(STRIPES)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in _runs(batches, longest - 1):
            yield _stripes(*full, longest, shards, arrow)

    return texts.mapInArrow(run, schema)


class _Merge:
    """Stripes that arrive in the order of their keys, merged entry by entry."""

    def __init__(self, longest: int, least: int):
        self.longest, self.least = longest, least
        self.keys: list[tuple] = []
        self.owner, self.entries, self.counts, self.size, self.limit = [], [], [], 0, ENTRIES_PER_MERGE

    def add(self, batch: pa.RecordBatch) -> None:
        keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
        numbers = []
        for key in keys:
            if not self.keys or self.keys[-1] != key:
                self.keys.append(key)
            numbers.append(len(self.keys) - 1)
        lists, counts = batch.column(3), batch.column(4)
        self.owner.append(np.repeat(numbers, pc.list_value_length(lists).to_numpy()).astype(np.int64))
        self.entries.append(lists.flatten())
        self.counts.append(counts.flatten().to_numpy())
        self.size += len(self.owner[-1])

    def out(self, last: bool) -> dict[str, list] | None:
        """Counts of the stripes that are complete: all but the last, which may go on in the next rows."""
        if not self.size:
            return None
        entries = pa.concat_arrays(self.entries).dictionary_encode()
        names, codes = entries.dictionary, entries.indices.to_numpy()
        key, place = np.unique(np.concatenate(self.owner) * len(names) + codes, return_inverse=True)
        counts = np.bincount(place, np.concatenate(self.counts), len(key)).astype(np.int64)
        owner, entries = key // len(names), names.take(pa.array(key % len(names)))
        done = len(key) if last else int(np.searchsorted(owner, len(self.keys) - 1))
        found = self._counts(owner[:done], entries[:done], counts[:done]) if done else None
        # What is held is merged already; it is merged again only after it has doubled.
        self.keys = self.keys[-1:]
        self.owner, self.entries, self.counts = [np.zeros(len(key) - done, np.int64)], [entries[done:]], [counts[done:]]
        self.size = len(key) - done
        self.limit = max(ENTRIES_PER_MERGE, 2 * self.size)
        return found

    def _counts(self, owner: np.ndarray, entries: pa.Array, counts: np.ndarray) -> dict[str, list]:
        """Of each stripe's word and of the phrases it begins: sums over the entries they share.

        Sums that may go on in another shard are given whatever their size: the word's own if its stripe is cut, and
        those of all shorter phrases if the pair is. Of all others only what reaches ``least`` leaves the task. The row
        without words counts everything.
        """
        langs = pa.array([key[0] for key in self.keys]).dictionary_encode()
        words, shard = pa.array([key[1] for key in self.keys]), np.array([key[2] for key in self.keys])
        per_lang = np.bincount(langs.indices.to_numpy()[owner], counts, len(langs.dictionary)).astype(np.int64)
        some = np.nonzero(per_lang)[0]
        rows = {
            "lang": langs.dictionary.take(pa.array(some)).to_pylist(),
            "phrase": [""] * len(some),
            "words": [0] * len(some),
            "n": per_lang[some].tolist(),
        }
        split = pc.split_pattern(entries, " ")
        depth = np.where(pc.equal(entries, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(split).to_numpy())
        for length in range(1, self.longest + 1):
            at = np.nonzero(depth >= length - 1)[0]
            if not len(at):
                continue
            heads = pc.binary_join(pc.list_slice(split.take(pa.array(at)), 0, max(length - 1, 1)), " ")
            heads = heads.dictionary_encode() if length > 1 else pa.array([""] * len(at)).dictionary_encode()
            size = len(heads.dictionary)
            key, place = np.unique(owner[at] * size + heads.indices.to_numpy(), return_inverse=True)
            n = np.bincount(place, counts[at], len(key)).astype(np.int64)
            partial = (shard != 0) if length == 1 else (shard < 0) & (length < self.longest)
            keep = np.nonzero((n >= self.least) | partial[key // size])[0]
            of = key[keep] // size
            first, rest = words.take(pa.array(of)), heads.dictionary.take(pa.array(key[keep] % size))
            phrases = first if length == 1 else pc.binary_join_element_wise(first, rest, " ")
            rows["lang"] += langs.take(pa.array(of)).to_pylist()
            rows["phrase"] += phrases.to_pylist()
            rows["words"] += [length] * len(keep)
            rows["n"] += n[keep].tolist()
        return rows


def phrase_counts(partial: DataFrame, longest: int, least: int) -> DataFrame:
    """``lang``, ``phrase``, ``words``, ``n`` of all phrases that occur ``least`` times, and ``words`` = 0 for all words.

    ``partial`` are stripes; one shuffle brings those of a word together, and tasks merge them in the order of their keys.
    """
    schema = StructType.fromDDL("lang string, phrase string, words int, n long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = _Merge(longest, least)
        for batch in batches:
            merge.add(batch)
            if merge.size >= merge.limit and (found := merge.out(last=False)):
                yield pa.RecordBatch.from_pydict(found, schema=arrow)
        if found := merge.out(last=True):
            yield pa.RecordBatch.from_pydict(found, schema=arrow)

    key = ["lang", "word", "shard"]
    merged = partial.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)
    summed = merged.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return summed.where((F.col("n") >= least) | (F.col("words") == 0))


def _first(count: str) -> Column:
    return F.expr(f"substring_index(phrase, ' ', {count})")


def _last(count: str) -> Column:
    return F.expr(f"substring_index(phrase, ' ', -({count}))")


def _cuts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Each candidate with its lowest-scoring cut: ``k``, ``l``, ``r``, ``score``."""
    known = counts.where("words > 0").select("lang", F.col("phrase").alias("part"), "n")
    whole = F.col("a").cast("decimal(18,0)")
    # Decimals of 38 digits, so squares of counts fit; l and r are at least a, so the score is a million at most.
    score = "(cast(1000000 as decimal(7,0)) * (_a * _a)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    return (
        candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        .withColumn("_left", _first("k"))
        .withColumn("_right", _last("words - k"))
        .join(known.select("lang", F.col("part").alias("_left"), F.col("n").alias("l")), ["lang", "_left"])
        .join(known.select("lang", F.col("part").alias("_right"), F.col("n").alias("r")), ["lang", "_right"])
        .withColumn("_a", whole)
        .groupBy("lang", "phrase", "words", "a")
        .agg(F.min(F.struct(F.expr(score).cast("long").alias("score"), "k", "l", "r")).alias("_cut"))
        .select("lang", "phrase", "words", "a", "_cut.*")
    )


def collocations(
    docs: DataFrame,
    words: tuple[int, int] = (2, 3),
    least: int = 10,
    subsumed_percent: int = 50,
    top: int = 2000,
    shard_size: int = SHARD,
) -> DataFrame:
    """The best phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``, ``k``.

    ``docs`` needs ``lang`` and ``text``; other columns are ignored, whatever their names. A null language is ``und``, a
    null text has no words; repeated rows count as often as they stand there. Phrases never cross the ends of pieces or texts.
    Ties go by count, then by phrase in byte order. No words, or no phrase of ``least`` occurrences, give no rows.
    """
    prepared(docs.sparkSession)
    shortest, longest = words
    if shortest < 2 or longest < shortest:
        raise ValueError("phrases have two words or more")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = materialised(phrase_counts(stripes(texts, longest, shard_size), longest, least))
    longer = (
        counts.where(F.col("words") > shortest)
        .select("lang", "n", F.explode(F.array(_first("words - 1"), _last("words - 1"))).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("n").alias("_longer"))
    )
    candidates = counts.where(F.col("words") >= shortest).withColumnRenamed("n", "a")
    subsumed = F.coalesce(100 * F.col("_longer") >= subsumed_percent * F.col("a"), F.lit(False))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(~subsumed).drop("_longer")
    totals = counts.where("words = 0").select("lang", "n")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (
        _cuts(kept, counts)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "k")
    )
