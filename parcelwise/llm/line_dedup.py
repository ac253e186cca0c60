"""Fuzzy removal of repeated lines, in native expressions only.

Lines are normalised to lower-case words. Equal normalised lines are one node. A node has a 64-bit SimHash of its words;
words of up to three letters carry no weight, as they would make unrelated lines of one language look alike; a line
of such words only has a hash of its own. Two nodes are linked if their SimHashes differ in at most ``MAX_BITS`` bits and the edit similarity of their word sequences is at
least ``SIMILARITY``. Of every connected group of lines the first occurrence stays, all others are removed.

Candidates: the 64 bits are cut into ``MAX_BITS + 2`` blocks. Two hashes that differ in at most ``MAX_BITS`` bits agree on two
blocks at least, so nodes meet under one of the pairs of blocks. Inside such a bucket every node is first compared
with the first node and a few predecessors in the order of the hashes, which is all there is in nearly every bucket; in
larger ones, after the groups so far are known, pairs of nodes in different groups are compared. A bucket of thousands
of alike lines thus costs some comparisons per line instead of one per pair.
"""

from __future__ import annotations

import string
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.shared import connected
from parcelwise.session import materialised

MIN_WORDS = 5
MAX_BITS = 3
SIMILARITY = 0.8
# Nodes before a node, in the order of the hashes of its bucket, that it is compared with.
NEIGHBOURS = 4
# Words whose bits are counted in one-byte lanes; longer lines add up several pieces.
PIECE = 127
# The bitmap that sorts out lines without a candidate: BITMAPS x 32768 bits, 4 KB each, whatever the input.
BITMAPS = 1024
LAST = (1 << 63) - 1
# Blanks and ASCII punctuation one by one: Java looks them up in a table, which it doesn't for \s and \p{Punct}.
SEPARATORS = "[" + "".join(f"\\x{ord(c):02x}" for c in string.whitespace + string.punctuation) + "]+"

ONES = 0x0101010101010101
EVEN = 0x00FF00FF00FF00FF
PAIR = 0x000000FF000000FF


def _words(line: str) -> Column:
    return F.array_remove(F.split(F.lower(F.col(line)), SEPARATORS), "")


def _lines(docs: DataFrame) -> DataFrame:
    """(``_d``, ``_k``, ``line``, ``raw``): every line with the key of its document."""
    # What stands beside a generator is computed once per generated row, so keys are made before.
    keyed = docs.select(*_key(), F.split("text", "\n").alias("all"))
    return keyed.select("_d", "_k", F.posexplode("all").alias("line", "raw"))


def _key() -> tuple[Column, Column]:
    """A document's id (nulls last) and a hash that tells texts under one id apart."""
    return (
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_d"),
        F.xxhash64("doc_id", "text").alias("_k"),
    )


def _fold(bits: list[Column]) -> Column:
    folded = bits[0]
    for b in bits[1:]:
        folded = folded.bitwiseOR(b)
    return folded


def _hash_of_piece() -> Column:
    """SimHash of a line of one piece: in each byte lane, whether the count exceeds half of ``n``."""
    above = (F.lit(127) - F.expr("n div 2")) * F.lit(0x0001000100010001)

    def lanes(column: Column) -> Column:
        return F.shiftright((column.bitwiseAND(EVEN) + above).bitwiseAND(0x0080008000800080), 7)

    return _fold(
        [
            F.shiftleft(
                lanes(F.col(f"s{i}")).bitwiseOR(F.shiftleft(lanes(F.shiftrightunsigned(f"s{i}", 8)), 8)), i
            )
            for i in range(8)
        ]
    )


def _hash_of_pieces(pieces: DataFrame) -> DataFrame:
    """SimHash of lines of several pieces, from counts in lanes of 32 bits."""
    wide = pieces.groupBy("_d", "_k", "line", "h", "r").agg(
        F.sum("n").alias("n"),
        *[
            F.sum(F.shiftrightunsigned(f"s{i}", 8 * j).bitwiseAND(PAIR)).alias(f"w{i}_{j}")
            for i in range(8)
            for j in range(4)
        ],
    )
    bits = [
        F.when(2 * F.shiftrightunsigned(f"w{i}_{j}", 32 * top).bitwiseAND(0xFFFFFFFF) > F.col("n"), F.lit(1 << at))
        .otherwise(F.lit(0))
        .cast("long")
        if (at := 8 * (j + 4 * top) + i) < 63
        else F.when(
            2 * F.shiftrightunsigned(f"w{i}_{j}", 32 * top).bitwiseAND(0xFFFFFFFF) > F.col("n"), F.lit(-LAST - 1)
        )
        .otherwise(F.lit(0))
        .cast("long")
        for i in range(8)
        for j in range(4)
        for top in range(2)
    ]
    return wide.select(
        "_d", "_k", "line", "h", "r", F.when(F.col("n") > 0, _fold(bits)).otherwise(F.col("h")).alias("fp")
    )


def hashed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(``_d``, ``_k``, ``line``, ``h``, ``r``, ``fp``): lines of at least ``min_words`` words with their SimHash.

    ``h`` identifies the normalised line (64 bits), ``r`` the line as it stands.
    """
    measured = (
        _lines(docs)
        .select("_d", "_k", "line", F.xxhash64("raw").alias("r"), _words("raw").alias("words"))
        .select(
            "_d",
            "_k",
            "line",
            "r",
            F.xxhash64("words").alias("h"),
            F.expr(f"cast((size(words) - 1) div {PIECE} + 1 as int)").alias("pieces"),
            "words",
        )
    )
    # Outer, and short lines go after counting: a filter on the words would split every line once more.
    words = measured.select("_d", "_k", "line", "r", "h", "pieces", F.posexplode_outer("words").alias("at", "word"))
    words = words.withColumn("bits", F.when(F.length("word") > 3, F.xxhash64("word")))
    counted = words.groupBy("_d", "_k", "line", "h", "r", "pieces", F.expr(f"at div {PIECE}").alias("piece")).agg(
        F.count("word").alias("n_words"),
        F.count("bits").alias("n"),
        *[F.sum(F.shiftrightunsigned("bits", i).bitwiseAND(ONES)).alias(f"s{i}") for i in range(8)],
    )
    counted = counted.where((F.col("pieces") > 1) | (F.col("n_words") >= min_words))
    single = F.col("pieces") == 1
    pieces = materialised(
        counted.select(
            "_d",
            "_k",
            "line",
            "h",
            "r",
            F.when(single, F.when(F.col("n") > 0, _hash_of_piece()).otherwise(F.col("h"))).alias("fp"),
            *[F.when(~single, F.col(c)).alias(c) for c in ("n", *(f"s{i}" for i in range(8)))],
        )
    )
    whole = pieces.where("fp is not null").select("_d", "_k", "line", "h", "r", "fp")
    return whole.unionByName(_hash_of_pieces(pieces.where("fp is null")))


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """First bit and width of each block."""
    cuts = [64 * k // (max_bits + 2) for k in range(max_bits + 3)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _buckets(fp: str, max_bits: int) -> list[Column]:
    """The bucket of a hash under each pair of blocks: the bits of both side by side, above them the number of the pair.

    One whole number, since rows are sorted by a single number without comparisons.
    """

    def bits(start: int, width: int) -> Column:
        return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    blocks = _blocks(max_bits)
    widest = max(width for _, width in blocks)
    return [
        F.shiftleft(bits(*x), y[1]).bitwiseOR(bits(*y)).bitwiseOR(F.lit(number << (2 * widest)).cast("long"))
        for number, (x, y) in enumerate(combinations(blocks, 2))
    ]


def _first_shared(fp: str, other: str, max_bits: int) -> Column:
    """The bucket two hashes share under the first pair of blocks on which they agree."""
    found = F.lit(None).cast("long")
    for mine, theirs in reversed(list(zip(_buckets(fp, max_bits), _buckets(other, max_bits), strict=True))):
        found = F.when(mine == theirs, mine).otherwise(found)
    return found


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _bucket_members(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(``bucket``, ``h``, ``fp``, ``n``, ``near``): nodes that share a bucket, its size, and alike nodes among a few.

    A node is compared with the bucket's first one and its ``NEIGHBOURS`` predecessors in the order of the hashes. Buckets
    of up to ``NEIGHBOURS + 2`` nodes are thereby done.
    """
    dealt = nodes.select("h", "fp", F.explode(F.array(*_buckets("fp", max_bits))).alias("bucket"))
    bucket = Window.partitionBy("bucket")
    along = bucket.orderBy("fp", "h")
    others = [F.struct(F.first("h").over(along).alias("h"), F.first("fp").over(along).alias("fp"))]
    others += [
        F.struct(F.lag("h", i).over(along).alias("h"), F.lag("fp", i).over(along).alias("fp"))
        for i in range(1, NEIGHBOURS + 1)
    ]
    # Nearly all nodes are alone in a bucket and go before anything is looked up.
    shared = dealt.select("*", F.count("*").over(bucket).alias("n")).where("n > 1")
    placed = shared.select("*", F.array(*others).alias("others"))
    alike = F.expr(f"filter(others, x -> x.h <> h and bit_count(x.fp ^ fp) <= {max_bits})")
    return materialised(
        placed.withColumn("near", alike).select("bucket", "h", "fp", "n", F.col("near.h").alias("near"))
    )


def _sequences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(``h``, ``words``) of the lines in ``wanted`` (``h``, ``r``), each word as one character.

    Lines whose bit is not set in a bitmap of fixed size are dropped without a shuffle; an exact join follows.
    """
    size = BITMAPS * 32768
    place = F.expr(f"pmod(r, {size}L)")
    maps = wanted.groupBy(F.expr(f"pmod(r, {size}L) div 32768").cast("int").alias("map")).agg(
        F.expr("bitmap_construct_agg(pmod(r, 32768L))").alias("bitmap")
    )
    byte = F.expr("conv(hex(substring(bitmap, cast(pmod(r, 32768L) div 8 as int) + 1, 1)), 16, 10)").cast("int")
    marked = F.expr("shiftright({0}, cast(pmod(r, 8L) as int)) & 1".format("byte")) == 1
    lines = _lines(docs).select("raw", F.xxhash64("raw").alias("r"))
    near = (
        lines.withColumn("map", (place / 32768).cast("int"))
        .join(F.broadcast(maps), "map")  # at most BITMAPS rows of 4 KB
        .withColumn("byte", byte)
        .where(marked)
        .select("r", "raw")
    )
    code = "lpad(hex(65536 + pmod(xxhash64(w), 1048576L)), 8, '0')"
    return (
        near.join(wanted, "r")
        .groupBy("h")
        .agg(F.first("raw").alias("raw"))
        .select("h", _words("raw").alias("words"))
        .select(
            "h",
            F.expr(f"decode(unhex(array_join(transform(words, w -> {code}), '')), 'UTF-32')").alias("words"),
        )
    )


def _verified(pairs: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose word sequences have the edit similarity; others are dropped."""
    left = sequences.select(F.col("h").alias("a"), F.col("words").alias("x"))
    right = sequences.select(F.col("h").alias("b"), F.col("words").alias("y"))
    allowed = f"cast(floor({1 - similarity:.6f} * greatest(length(x), length(y)) + 1e-9) as int)"
    return pairs.join(left, "a").join(right, "b").where(f"levenshtein(x, y, {allowed}) >= 0").select("a", "b")


def line_classes(
    docs: DataFrame, min_words: int = MIN_WORDS, max_bits: int = MAX_BITS, similarity: float = SIMILARITY
) -> tuple[DataFrame, DataFrame]:
    """All line occurrences (``_d``, ``_k``, ``line``, ``h``), and per ``h`` of a class with several occurrences the first one."""
    lines = materialised(hashed_lines(docs, min_words))
    nodes = materialised(
        lines.groupBy("h").agg(
            F.min("fp").alias("fp"),
            F.min(F.struct("_d", "_k", "line")).alias("first"),
            F.min("r").alias("r"),
            F.count("*").alias("times"),
        )
    )
    members = _bucket_members(nodes.select("h", "fp"), max_bits)
    star = members.select(F.col("h").alias("a"), F.explode("near").alias("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    star = materialised(star.distinct())
    everyone = members.where(F.col("n") > NEIGHBOURS + 2).select("bucket", "h", "fp")
    named = star.select("a").unionByName(star.select(F.col("b").alias("a"))).unionByName(
        everyone.select(F.col("h").alias("a"))
    )
    wanted = named.distinct().join(nodes.select("h", "r"), F.col("a") == F.col("h")).select("h", "r")
    sequences = materialised(_sequences(docs, wanted))
    links = materialised(_verified(star, sequences, similarity))
    groups = materialised(connected(links))
    # Larger buckets that still hold several groups: pairs across groups only, each in the first bucket they share.
    placed = everyone.join(groups, F.col("h") == F.col("node"), "left").select(
        "bucket", "h", "fp", F.coalesce("root", "h").alias("root")
    )
    placed = materialised(placed)
    mixed = (
        placed.groupBy("bucket")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low <> high")
        .select("bucket")
    )
    rest = placed.join(mixed, "bucket", "left_semi")
    other = rest.select(*[F.col(c).alias(f"_{c}") for c in ("bucket", "h", "fp", "root")])
    across = rest.join(
        other,
        (F.col("bucket") == F.col("_bucket"))
        & (F.col("h") < F.col("_h"))
        & (F.col("root") != F.col("_root"))
        & (_distance("fp", "_fp") <= max_bits)
        & (F.col("bucket") == _first_shared("fp", "_fp", max_bits)),
    ).select(F.col("h").alias("a"), F.col("_h").alias("b"))
    more = materialised(_verified(across.distinct(), sequences, similarity))
    if not more.isEmpty():
        groups = connected(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    named = nodes.join(groups, F.col("h") == F.col("node"), "left").select(
        "h", "first", "times", F.coalesce("root", "h").alias("root")
    )
    named = materialised(named)
    firsts = named.groupBy("root").agg(F.min("first").alias("first"), F.sum("times").alias("times")).where("times > 1")
    kept = named.select("h", "root").join(firsts, "root").select("h", "first")
    return lines.select("_d", "_k", "line", "h"), kept


def deduplicated(
    docs: DataFrame, min_words: int = MIN_WORDS, max_bits: int = MAX_BITS, similarity: float = SIMILARITY
) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and a struct ``_lines`` (``n_lines``, ``n_removed``).

    Lines are the pieces between line feeds. Lines of fewer than ``min_words`` words (blank ones too) are left alone. Of
    each group of linked lines the occurrence with the smallest ``doc_id`` (nulls last), and within a document the
    first, stays. Removed lines vanish with their line feed; a document may end up empty but its row stays. A null
    text stays null and has no lines. Several rows of one id and different texts count as different documents, rows
    alike in both as one. An ``n_chars`` column follows the new text; other columns pass through. An empty table gives
    an empty result.
    """
    lines, kept = line_classes(docs, min_words, max_bits, similarity)
    removed = (
        lines.join(kept, "h")
        .where(F.struct("_d", "_k", "line") != F.col("first"))
        .groupBy("_d", "_k")
        .agg(F.collect_set("line").alias("_gone"))
    )
    split = F.split("text", "\n")
    rest = F.expr("array_join(transform(array_except(sequence(0, size(_all) - 1), _gone), i -> _all[i]), '\\n')")
    joined = (
        docs.select("*", *_key())
        .join(removed, ["_d", "_k"], "left")
        .withColumn("_all", split)
        .withColumn("_new", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(rest))
    )
    shown = {
        "text": F.col("_new").alias("text"),
        "n_chars": F.length("_new").cast(docs.schema["n_chars"].dataType if "n_chars" in docs.columns else "long").alias("n_chars"),
    }
    counts = F.struct(
        F.coalesce(F.when(F.col("text").isNotNull(), F.size("_all")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
    return joined.select(*[shown.get(c, F.col(f"`{c}`")) for c in docs.columns], counts.alias("_lines"))
