"""SimHash near-duplicates: a self-join of fingerprints by descending a binary trie in pairs of nodes.

Fingerprints within ``max_bits`` of each other agree on at least one of ``max_bits + 1`` blocks, so the tries
below one block value are joined separately and in parallel. Inside a task the trie is the sorted array of
fingerprints: a node is a range of it, and a level of node pairs is a few numpy columns. A pair of nodes carries
the number of differing bits so far and is given up when that exceeds the budget. A task returns a spanning
forest of its links instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.shared import arrow_map, connected, merge_classes
from parcelwise.session import materialised

SEED = 42
# A trie with more fingerprints than this is cut again along a block of its undecided bits.
LARGE_TRIE = 20_000
# Fingerprints that are joined at once, and node pairs that are held at once, in one task.
BATCH = 100_000
PAIRS_AT_ONCE = 500_000
SHINGLES_AT_ONCE = 65_536


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text; zero if it has no words.

    A-Z are lower-cased, words are runs of non-space bytes, fewer words than a shingle form one shingle.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    ones, total = np.zeros(64, np.int64), len(found) - words + 1
    hashed = xxhash.xxh64_intdigest
    for start in range(0, total, SHINGLES_AT_ONCE):
        part = found[start : start + SHINGLES_AT_ONCE + words - 1]
        values = [hashed(s, SEED) for s in map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False))]
        bits = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits((2 * ones > total).astype(np.uint8), bitorder="little")
    return int(set_bits.view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _row_key() -> Column:
    """Tells texts under one id apart."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(``doc_id``, ``key``, ``fp``): the key of every row and the fingerprint of its text as a signed long."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield {n: batch[n] for n in ("doc_id", "key")} | {"fp": [_signed(fingerprint(t, words)) for t in batch["text"]]}

    keyed = docs.select(F.col("doc_id").cast("long"), _row_key().alias("key"), "text")
    return arrow_map(keyed, "doc_id long, key long, fp long", rows)


def trie_links(group: np.ndarray, fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Class of every position: the smallest position linked to it inside its group.

    ``fp`` (unsigned) is sorted within equal, adjacent ``group`` values; the root of each trie is such a run.
    """
    n = len(fp)
    label = np.arange(n)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.array([], np.int64)
    ends = np.r_[starts[1:], n] if n else starts
    wide = ends - starts > 1
    level = np.stack([starts[wide], ends[wide], starts[wide], ends[wide], np.zeros(wide.sum(), np.int64)])
    stack = [(63, level)]
    ones = {}
    while stack:
        bit, level = stack.pop()
        if not level.shape[1]:
            continue
        if level.shape[1] > PAIRS_AT_ONCE:
            half = level.shape[1] // 2
            stack += [(bit, level[:, half:]), (bit, level[:, :half])]
            continue
        # Pairs of single fingerprints are compared at once; pairs already in one class need no comparison.
        leaf = (level[1] - level[0] == 1) & (level[3] - level[2] == 1)
        if leaf.any():
            i, j = level[0, leaf], level[2, leaf]
            undecided = label[i] != label[j]
            i, j = i[undecided], j[undecided]
            near = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
            merge_classes(label, i[near], j[near])
            level = level[:, ~leaf]
        if bit < 0:  # no bits left: both nodes hold copies of one fingerprint each
            merge_classes(label, level[0], level[2])
            continue
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)]
        count = ones[bit]
        a0, a1, b0, b1, wrong = level
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        own = a0 == b0
        other = ~own
        below = np.concatenate(
            [
                np.stack([a0, am, b0, bm, wrong]),
                np.stack([am, a1, bm, b1, wrong]),
                np.stack([a0, am, bm, b1, wrong + 1]),
                np.stack([am, a1, b0, bm, wrong + 1])[:, other],
            ],
            axis=1,
        )
        size_a, size_b = below[1] - below[0], below[3] - below[2]
        alive = (size_a > 0) & (size_b > 0) & (below[4] <= max_bits) & ~((below[0] == below[2]) & (size_a == 1))
        stack.append((bit - 1, below[:, alive]))
    return label


def _joined(batches: Iterator[dict], max_bits: int) -> Iterator[dict]:
    """Spanning links of the tries in a partition sorted by ``trie`` and unsigned fingerprint."""

    def solve(group: np.ndarray, fp: np.ndarray) -> dict:
        unsigned = fp.view(np.uint64)
        label = trie_links(group, unsigned, max_bits)
        linked = np.flatnonzero(label != np.arange(len(fp)))
        return {"a": fp[linked], "b": fp[label[linked]]}

    groups, values, held = [], [], 0
    for batch in batches:
        groups.append(np.array(batch["trie"], np.int64))
        values.append(np.array(batch["fp"], np.int64))
        held += len(values[-1])
        if held < BATCH:
            continue
        group, fp = np.concatenate(groups), np.concatenate(values)
        cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if group[0] != group[-1] else 0
        if cut:
            yield solve(group[:cut], fp[:cut])
        groups, values, held = [group[cut:]], [fp[cut:]], held - cut
    if held:
        yield solve(np.concatenate(groups), np.concatenate(values))


def _tries(distinct: DataFrame, max_bits: int, large: int) -> DataFrame:
    """(``trie``, ``fp``): each fingerprint in one trie per block of bits; large tries are cut again.

    A trie is the set of fingerprints that agree on the bits of a mask. The masks of one level share out the bits
    that are still free, so a pair within ``max_bits`` meets in at least one trie of every level.
    """
    parts = max_bits + 1

    def shares(mask: int) -> list[int]:
        bits = [i for i in range(64) if mask >> i & 1]
        cuts = [len(bits) * k // parts for k in range(parts + 1)]
        return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    everything = (1 << 64) - 1

    def dealt(df: DataFrame, agreed: int) -> DataFrame:
        masks = [_signed(agreed | m) for m in shares(everything & ~agreed) if m]
        out = df.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
        return out.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))

    def level(df: DataFrame, agreed_masks: list[int]) -> DataFrame:
        made = None
        for agreed in agreed_masks:
            own = dealt(df if len(agreed_masks) == 1 else df.where(F.col("mask") == F.lit(_signed(agreed))), agreed)
            made = own if made is None else made.unionByName(own)
        return made

    done, masks, current = None, [0], distinct
    while True:
        current = level(current, masks)
        masks = [m | s for m in masks for s in shares(everything & ~m) if s]
        sizes = current.groupBy("mask", "key").count().where(F.col("count") > large)
        big = materialised(sizes.select("mask", "key"))
        small = current.join(big, ["mask", "key"], "left_anti")
        done = small if done is None else done.unionByName(small)
        if big.isEmpty():
            break
        if min(64 - m.bit_count() for m in masks) <= 2 * parts or len(masks) > parts**2:
            done = done.unionByName(current.join(big, ["mask", "key"], "left_semi"))
            break
        current = materialised(current.join(big, ["mask", "key"], "left_semi"))
    return done.select(F.xxhash64("mask", "key").alias("trie"), "mask", "key", "fp")


def linked_fingerprints(distinct: DataFrame, max_bits: int = 3, large: int = LARGE_TRIE) -> DataFrame:
    """Spanning links (``a``, ``b``) of the fingerprints in column ``fp`` at ``max_bits`` or fewer differing bits."""
    # Two tries under one hash would only be searched together: links are verified on the fingerprints.
    dealt = _tries(distinct, max_bits, large).repartition("trie")
    ordered = dealt.sortWithinPartitions("trie", F.col("fp") < 0, "fp").select("trie", "fp")
    return arrow_map(ordered, "a long, b long", lambda batches: _joined(batches, max_bits))


def _components(docs: DataFrame, words: int, max_bits: int, large: int) -> DataFrame:
    """(``doc_id``, ``key``, ``fp``, ``root``, ``component_id``): every row with its component and the smallest id there."""
    marked = materialised(fingerprints(docs, words))
    distinct = materialised(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(linked_fingerprints(distinct.select("fp"), max_bits, large))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialised(named.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id"))
    return marked.join(classes, "fp").select("doc_id", "key", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3, large: int = LARGE_TRIE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Documents are linked if their fingerprints differ in at most ``max_bits`` bits; ``component_id`` is the smallest
    ``doc_id`` reachable over links. A null text counts as empty, and all texts without words share fingerprint
    zero, which is linked like any other. A null ``doc_id`` never names a component: it gets the smallest id of its
    component, or null if there is none. Rows with a repeated id keep one output row each. Other columns of
    ``docs`` are ignored. An empty table gives an empty result.
    """
    return _components(docs, words, max_bits, large).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_component(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` without near-copies: of every component a row with the smallest ``doc_id`` stays.

    Rows with a null id name no component and are kept. Rows of one id and different texts are rows of their own: each
    stays or goes with its component.
    """
    found = _components(docs.select("doc_id", "text"), words, max_bits, LARGE_TRIE)
    kept = found.where("doc_id = component_id").groupBy("root").agg(F.min("key").alias("_kept"))
    named = docs.where("doc_id is not null")
    stays = named.join(kept.select("_kept"), _row_key() == F.col("_kept"), "left_semi")
    # Rows alike in id and text are one.
    return stays.dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))
