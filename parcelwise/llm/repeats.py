"""Removal of long repeated byte strings with a run-length index.

A window is a string of ``length`` bytes inside one document; a byte goes if a window that covers it also starts
anywhere else. Every window belongs to the 32-byte string of smallest hash in it, its anchor. Equal windows have equal
anchors at equal offsets, so they meet under the anchor's hash wherever they are. Consecutive windows of one anchor
form a run, and runs are what is shuffled: one in some hundred bytes, with a hash of all bytes it spans.

Runs that span the same bytes as another one are repeated as a whole, which a count with map-side combine
finds. What is left are runs whose anchor also has runs with other bytes: the edges of passages and edited copies. Their bytes
are gathered by anchor into blocks, and each block is indexed: suffix array, run-length Burrows-Wheeler transform, and the
text positions and common prefixes at the ends of its runs. From these samples the matching statistics of the block against
itself (the longest match of each position with any other) are streamed in text order, and windows with
matches of ``length`` or more are marked. Repetitive blocks have few transform runs and hence few samples.

An anchor with more bytes than a block may hold is resolved by hashing parts of its runs, from coarse to fine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.shared import arrow_map
from parcelwise.session import materialised

LENGTH = 400
GRAM = 32
# Window starts looked at together in one text; positions inside must fit into 24 bits.
SEGMENT = 1 << 19
PLACE_BITS = 24
# Bytes indexed together, and bytes of one anchor beyond which hashing takes over.
BLOCK_BYTES = 1 << 20
LARGE_ANCHOR = 4 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


_BYTES = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at each position, by doubling."""
    h, size = _BYTES[data], 1
    while size < GRAM:
        h = _mixed(h[: len(h) - size] * np.uint64(0xBF58476D1CE4E5B9) + (h[size:] ^ np.uint64(size)))
        size *= 2
    return h


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys."""
    size, low = 1, keys
    while 2 * size <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    return np.minimum(low[: len(low) - (width - size)], low[width - size :])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def anchored_runs(text: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """(first window, last window, anchor, anchor hash) of every run of a text, in order."""
    data = np.frombuffer(text, np.uint8)
    low_bits = np.uint64((1 << PLACE_BITS) - 1)
    for start in range(0, len(data) - length + 1, SEGMENT):
        part = data[start : start + SEGMENT + length - 1]
        grams = gram_hashes(part)
        # The leftmost smallest hash: its upper bits, then the place.
        keys = (grams & ~low_bits) | np.arange(len(grams), dtype=np.uint64)
        place = (_smallest(keys, length - GRAM + 1) & low_bits).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:] - 1, len(place) - 1]
        anchors = place[first]
        yield from zip(
            (first + start).tolist(),
            (last + start).tolist(),
            (anchors + start).tolist(),
            grams[anchors].astype(np.int64).tolist(),
            strict=True,
        )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal stretches covered by half-open spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


class RunLengthIndex:
    """Run-compressed transform of several texts with samples at the ends of its runs.

    ``heads`` and ``tails`` are text positions of the first and last suffix of each run of equal preceding symbols,
    ``before`` and ``after`` the lengths these have in common with the neighbouring suffix outside the run.
    """

    def __init__(self, texts: list[bytes]) -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.r_[0, np.cumsum(sizes + 1)][:-1]
        total = int((sizes + 1).sum())
        joined = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
        symbols = joined.astype(np.int64)
        # Every text ends in a symbol of its own, so matches end with their texts.
        ends = self.starts + sizes
        symbols[ends] = 256 + np.arange(len(texts))
        self.left = np.repeat(ends, sizes + 1) - np.arange(total)
        order = self._suffixes(joined, self.left)
        preceding = symbols[order - 1]
        changed = preceding[1:] != preceding[:-1]
        words = np.zeros(total + 8, np.uint8)
        words[:total] = joined
        self.words = np.lib.stride_tricks.sliding_window_view(words, 8).copy().view("<u8").ravel()
        at = np.flatnonzero(changed)  # the boundary between suffix at and at + 1
        common = self._common(order[at], order[at + 1])
        self.heads, self.before = order[at + 1], common
        self.tails, self.after = order[at], common
        self.runs = len(at) + 1
        self.total = total
        del self.words

    @staticmethod
    def _suffixes(joined: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling: the first symbols packed into one key, then only what is still tied.

        ``left`` counts the symbols up to the end of each text, ends sort before all else and among each other by place.
        A key carries its place in its low bits, so that values are sorted instead of an index into them.
        """
        n = len(joined)
        bits = np.uint64(max(1, int(n - 1).bit_length()))
        places = (np.uint64(1) << bits) - np.uint64(1)
        ended = left == 0
        used = np.zeros(256, np.uint64)
        used[joined[~ended]] = 1
        codes = np.cumsum(used, dtype=np.uint64)[joined]
        codes[ended] = 0
        width = max(1, int(codes.max()).bit_length())
        size = (64 - int(bits)) // width
        key = np.zeros(n, np.uint64)
        for i in range(size):
            key <<= np.uint64(width)
            key[: n - i] |= codes[i:]
        # What follows the end of a text does not count.
        short = np.flatnonzero(left < size)
        gone = (width * (size - left[short])).astype(np.uint64)
        key[short] = key[short] >> gone << gone
        key = (key << bits) | np.arange(n, dtype=np.uint64)
        key.sort()
        order = (key & places).astype(np.int64)
        key >>= bits
        tied = (key[1:] == key[:-1]) & (left[order[1:]] >= size)
        rank = np.empty(n, np.int64)
        slots, found = np.arange(n), order
        while True:
            first = np.flatnonzero(np.r_[True, ~tied])
            group = np.repeat(slots[first], np.diff(np.r_[first, len(slots)]))
            rank[found] = group
            open_ = np.flatnonzero(np.r_[tied, False] | np.r_[False, tied])
            if not len(open_):
                return order
            slots, found, group = slots[open_], found[open_], group[open_].astype(np.uint64)
            following = rank[found + size].astype(np.uint64)
            if 3 * int(bits) <= 64:
                key = (((group << bits) | following) << bits) | found.astype(np.uint64)
                key.sort()
                found = (key & places).astype(np.int64)
                key >>= bits
            else:
                key = (group << bits) | following
                by = np.argsort(key)
                key, found = key[by], found[by]
            order[slots] = found
            tied = key[1:] == key[:-1]
            size *= 2

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b``, eight bytes a step."""
        limit = np.minimum(self.left[a], self.left[b])
        found = np.zeros(len(a), np.int64)
        open_ = np.flatnonzero(limit > 0)
        while len(open_):
            at = found[open_]
            differ = self.words[a[open_] + at] ^ self.words[b[open_] + at]
            lowest = differ & (~differ + np.uint64(1))
            equal = np.where(differ == 0, 8, np.bitwise_count(lowest - np.uint64(1)) // 8)
            found[open_] = np.minimum(at + equal, limit[open_])
            open_ = open_[(differ == 0) & (found[open_] < limit[open_])]
        return found

    def matching_statistics(self) -> np.ndarray:
        """For each position of the joined texts the longest match of what follows with any other position.

        The length shrinks by one from a position to the next unless a sample there says more, so position plus
        length is the running maximum over the samples.
        """
        best = np.zeros(self.total, np.int64)
        for places, lengths in ((self.heads, self.before), (self.tails, self.after)):
            reach = np.zeros(self.total, np.int64)
            np.maximum.at(reach, places, places + lengths)
            best = np.maximum(best, np.maximum.accumulate(reach) - np.arange(self.total))
        return np.minimum(best, self.left)


def _runs_of(docs: DataFrame, length: int) -> DataFrame:
    """(``k``, ``s``, ``e``, ``a``, ``g``, ``c``, ``times``): the runs of every text, with a hash of the bytes they span.

    A run whose bytes occur again in its own text stands there once, with ``times`` 2, and rows without ``g`` give
    the byte spans [``s``, ``e``) that these cover.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("k", "s", "e", "a", "g", "c", "times")}
            for k, text in zip(batch["_k"], batch["text"], strict=True):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                own: dict[tuple[int, int], list] = {}
                covered = []
                for s, e, a, g in anchored_runs(data, length) if len(data) >= length else ():
                    c = _signed(xxhash.xxh3_64_intdigest(data[s : e + length]))
                    if known := own.get((g, c)):
                        if known[3] == 1:
                            covered.append((known[0], known[1] + length))
                        known[3] = 2
                        covered.append((s, e + length))
                        if len(covered) > 4096:
                            covered = merged(covered)
                    else:
                        own[g, c] = [s, e, a, 1]
                for (g, c), (s, e, a, times) in own.items():
                    for name, value in zip(out, (k, s, e, a, g, c, times), strict=True):
                        out[name].append(value)
                for s, e in merged(covered):
                    for name, value in zip(out, (k, s, e, None, None, None, None), strict=True):
                        out[name].append(value)
                if len(out["k"]) > 50_000:
                    yield out
                    out = {n: [] for n in out}
            yield out

    schema = "k long, s int, e int, a int, g long, c long, times int"
    return arrow_map(docs.select("_k", "text"), schema, rows)


def _contents(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """``runs`` (one row per ``c``) with the bytes they span, and their number of bytes."""
    per_text = runs.groupBy("k").agg(F.collect_list(F.struct("s", "e", "a", "g", "done")).alias("runs"))
    texts = docs.select(F.col("_k").alias("k"), "text").dropDuplicates(["k"]).join(per_text, "k")

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("k", "s", "e", "a", "g", "done", "bytes")}
            for k, text, found in zip(batch["k"], batch["text"], batch["runs"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for r in found:
                    out["k"].append(k)
                    for name, value in r.items():
                        out[name].append(value)
                    out["bytes"].append(data[r["s"] : r["e"] + length])
                if len(out["k"]) > 4096:
                    yield out
                    out = {n: [] for n in out}
            yield out

    return arrow_map(texts, "k long, s int, e int, a int, g long, done boolean, bytes binary", rows)


def indexed_spans(blocks: Iterator[list[dict]], length: int) -> Iterator[dict]:
    """Spans of the runs in each block that are not done yet, by the index of the block."""
    for block in blocks:
        index = RunLengthIndex([r["bytes"] for r in block])
        statistics = index.matching_statistics()
        out: dict[str, list] = {"k": [], "s": [], "e": []}
        hits = np.flatnonzero(statistics >= length)
        owner = np.searchsorted(index.starts, hits, side="right") - 1
        # Neighbouring windows of one run make one span.
        first = np.flatnonzero(np.r_[True, (hits[1:] != hits[:-1] + 1) | (owner[1:] != owner[:-1])]) if len(hits) else hits
        last = np.r_[first[1:], len(hits)] - 1 if len(hits) else hits
        for i, j in zip(first.tolist(), last.tolist(), strict=True):
            run = block[owner[i]]
            if not run["done"]:
                offset = run["s"] - int(index.starts[owner[i]])
                out["k"].append(run["k"])
                out["s"].append(int(hits[i]) + offset)
                out["e"].append(int(hits[j]) + offset + length)
        yield out


def _by_index(contents: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """Spans (``k``, ``s``, ``e``): whole anchors are packed into blocks, each block is indexed."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        def blocks() -> Iterator[list[dict]]:
            held: list[dict] = []
            size, anchor = 0, None
            for batch in batches:
                names = list(batch)
                for values in zip(*batch.values(), strict=True):
                    run = dict(zip(names, values, strict=True))
                    if run["g"] != anchor and size >= block_bytes:
                        yield held
                        held, size = [], 0
                    anchor = run["g"]
                    held.append(run)
                    size += len(run["bytes"]) + 1
            if held:
                yield held

        yield from indexed_spans(blocks(), length)

    ordered = contents.repartition("g").sortWithinPartitions("g", "k", "s")
    return arrow_map(ordered, "k long, s int, e int", rows)


def _by_hashes(contents: DataFrame, length: int) -> DataFrame:
    """Spans (``k``, ``s``, ``e``) of the runs of large anchors, by counting hashes of ever smaller parts.

    A part holds the windows whose distance to the anchor lies in one cell of a grid. All its windows share a core;
    a part whose core is unique has no repeated window, one that occurs again as a whole has only repeated ones. The
    others are cut into finer cells, down to single windows.
    """

    def cut(width: int):
        def rows(batches: Iterator[dict]) -> Iterator[dict]:
            for batch in batches:
                out: dict[str, list] = {n: [] for n in names}
                for k, s, e, a, g, done, data in zip(*(batch[n] for n in batch), strict=True):
                    low, high = a - e, a - s  # distances of the windows
                    for cell in range(low // width, high // width + 1):
                        x, y = max(low, cell * width), min(high, cell * width + width - 1)
                        part = data[a - y - s : a - x - s + length]
                        core = data[a - cell * width - s : a - cell * width - width + 1 - s + length]
                        values = (
                            k,
                            a - y,
                            a - x,
                            a,
                            g,
                            done,
                            part,
                            cell,
                            _signed(xxhash.xxh3_64_intdigest(core)),
                            _signed(xxhash.xxh3_64_intdigest(part, seed=x * 1024 + y)),
                        )
                        for name, value in zip(names, values, strict=True):
                            out[name].append(value)
                    if len(out["k"]) > 4096:
                        yield out
                        out = {n: [] for n in names}
                yield out

        names = ("k", "s", "e", "a", "g", "done", "bytes", "cell", "core", "part")
        return rows

    schema = (
        "k long, s int, e int, a int, g long, done boolean, bytes binary, cell int, core long, part long"
    )
    found, current = None, contents.select("k", "s", "e", "a", "g", "done", "bytes")
    for width in (64, 8, 1):
        parts = materialised(arrow_map(current, schema, cut(width)))
        cell = ["g", "cell", "core"]
        counted = parts.groupBy(*cell, "part").agg(
            F.count("*").alias("times"), F.min(F.struct("k", "s")).alias("one"), F.max("done").alias("any_done")
        )
        counted = materialised(counted)
        again = counted.where("times > 1 or any_done").select(*cell, "part", "one")
        whole = parts.join(again.where("one is not null"), [*cell, "part"]).where("not done")
        # A part that stands once and is done only serves the others.
        spans = whole.select("k", "s", (F.col("e") + length).alias("e"))
        found = spans if found is None else found.unionByName(spans)
        if width == 1:
            break
        several = counted.groupBy(*cell).agg(F.count("*").alias("n")).where("n > 1").select(*cell)
        open_ = parts.join(several, cell, "left_semi").join(
            again.select(*cell, "part", F.col("one").alias("_one")), [*cell, "part"], "left"
        )
        current = open_.where("_one is null or _one = struct(k, s)").select(
            "k", "s", "e", "a", "g", (F.col("done") | F.col("_one").isNotNull()).alias("done"), "bytes"
        )
    return found


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, large_anchor: int = LARGE_ANCHOR
) -> DataFrame:
    """(``k``, ``spans``): the sorted maximal repeated byte spans per text key of ``docs`` (``_k``, ``text``)."""
    runs = materialised(_runs_of(docs, length))
    real = runs.where("g is not null")
    counted = materialised(
        real.groupBy("g", "c").agg(F.sum("times").alias("times"), F.min(F.struct("k", "s")).alias("one"))
    )
    several = counted.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    # Runs that occur again as a whole, and those that share only their anchor with others.
    whole = counted.where("times > 1").select("g", "c")
    judged = real.join(whole, ["g", "c"], "left_semi")
    spans = runs.where("g is null").select("k", "s", "e").unionByName(
        judged.select("k", "s", (F.col("e") + length).alias("e"))
    )
    edges = counted.join(several, "g", "left_semi").select(
        "g", "c", F.col("one.k").alias("k"), F.col("one.s").alias("s"), (F.col("times") > 1).alias("done")
    )
    edges = edges.join(real.select("g", "c", "k", "s", "e", "a").dropDuplicates(["g", "c", "k", "s"]), ["g", "c", "k", "s"])
    contents = materialised(_contents(docs, edges, length))
    sizes = contents.groupBy("g").agg(F.sum(F.octet_length("bytes")).alias("n")).where(f"n > {large_anchor}")
    large = materialised(sizes.select("g"))
    spans = spans.unionByName(_by_index(contents.join(large, "g", "left_anti"), length, block_bytes))
    if not large.isEmpty():
        spans = spans.unionByName(_by_hashes(contents.join(large, "g", "left_semi"), length))
    return spans.groupBy("k").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def without_repeats(
    docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, large_anchor: int = LARGE_ANCHOR
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``spans`` (removed, as start and end byte), ``kept`` (binary).

    Texts are UTF-8 bytes. All bytes covered by a string of ``length`` bytes that also starts anywhere else, in the same
    text too, are removed; matches never cross texts and are judged on the input. Rows alike in id and text are
    repeats of each other like any others. A null text counts as empty; other columns are ignored; an empty table
    gives an empty result.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("_k"))
    found = repeated_spans(keyed, length, block_bytes, large_anchor)
    joined = keyed.join(found, F.col("_k") == F.col("k"), "left").select("doc_id", "text", "spans")

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("n_bytes", "spans", "kept")}
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                gone = merged([(x["s"], x["e"]) for x in spans or ()])
                edges = [0, *(x for span in gone for x in span), len(data)]
                out["n_bytes"].append(len(data))
                out["spans"].append([{"start": a, "end": b} for a, b in gone])
                out["kept"].append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield {"doc_id": batch["doc_id"], **out}

    schema = "doc_id long, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept binary"
    return arrow_map(joined, schema, rows)
