"""Near-duplicate vectors by sorted projection passes.

A pass draws random hyperplanes, writes the side of each as one bit, and sorts all vectors by the bits as a word. Similar
vectors share a long beginning of the word in some pass and so come to stand close together; each vector is
compared with a fixed number of predecessors. Verified pairs of all passes are united to components.

Where many vectors are alike without being linked, as in a narrow cone, a window holds a small part of them in every
pass. A vector that has such neighbours in half its window belongs to a dense group: what the windows of all passes
join at ``NEAR``. Inside these groups all pairs are compared, block by block.

Passes see a bounded window only, so in a component of many vectors they find its members but not all pairs. Those
are completed exactly: angles to the component's first vector decide most pairs by the triangle inequality (two vectors
within half the limit of it are linked for certain), and only members further away are compared with the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.shared import arrow_map, connected, merge_classes
from parcelwise.session import materialised

COSINE = 0.95
PASSES = 16
# Passes that share one exchange: it moves each vector once per pass.
PASSES_AT_ONCE = 4
WINDOW = 32
BITS = 63
SEED = 11
# Vectors of a component compared as one block, and rows sorted and compared at once.
BLOCK = 1024
CHUNK = 8192
# Cosine from which unlinked neighbours make a stretch dense, and vectors of a dense group compared as one block.
NEAR = 0.5
DENSE_BLOCK = 8192


def unit(vector: list | None) -> np.ndarray | None:
    """The vector at length one in double precision; nothing if it is null, zero, or has null or non-finite parts."""
    if not vector or None in vector:
        return None
    values = np.array(vector, np.float64)
    if not np.isfinite(values).all() or not values.any():
        return None
    values /= np.abs(values).max()  # so that no square overflows or vanishes
    return values / np.sqrt(values @ values)


def words(vectors: np.ndarray, turn: int, seed: int = SEED) -> np.ndarray:
    """The sort word of each row in one pass: ``BITS`` hyperplane sides, the first one highest."""
    planes = np.random.default_rng([seed, turn, vectors.shape[1]]).standard_normal((vectors.shape[1], BITS))
    return ((vectors @ planes) > 0) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _distinct(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows as (``vec_id``, ``node``) and each different vector once as (``node``, ``size``, ``unit``, ``times``, ``least``)."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            units = [unit(v) for v in batch["embedding"]]
            yield {
                "node": batch["node"],
                "times": batch["times"],
                "least": batch["least"],
                "size": [0 if u is None else len(u) for u in units],
                "unit": units,
            }

    keyed = vectors.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.xxhash64("embedding").alias("node")
    )
    grouped = keyed.groupBy("node").agg(
        F.count("*").alias("times"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding")
    )
    schema = "node long, times long, least long, size int, unit array<double>"
    return keyed.select("vec_id", "node"), materialised(arrow_map(grouped, schema, rows).where("size > 0"))


def _spanning(size: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that are not the first of their class under the links, and the first ones."""
    label = np.arange(size)
    merge_classes(label, a, b)
    linked = np.flatnonzero(label != np.arange(size))
    return linked, label[linked]


def window_pairs(
    groups: np.ndarray, vectors: np.ndarray, carried: int, window: int, cosine: float, near: float = NEAR
) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Positions of linked pairs at most ``window`` rows apart in one group, without pairs inside the carried rows, and
    of pairs that hold dense stretches together: rows with unlinked ones from ``near`` on in half their window, and the nearest
    and the farthest of these."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    alike = np.zeros(len(vectors), np.int64)
    nearest, farthest = np.zeros_like(alike), np.zeros_like(alike)
    for d in range(1, min(window, len(vectors) - 1) + 1):
        first = max(0, carried - d)
        cosines = np.einsum("ij,ij->i", vectors[first + d :], vectors[first : len(vectors) - d])
        same = groups[first + d :] == groups[first : len(groups) - d]
        at = np.flatnonzero(same & (cosines >= cosine)) + first
        found.append((at, at + d))
        at = np.flatnonzero(same & (cosines >= near) & (cosines < cosine)) + first
        nearest[at + d] = np.where(alike[at + d] == 0, at, nearest[at + d])
        farthest[at + d] = at
        alike[at + d] += 1
    dense = np.flatnonzero(2 * alike >= max(window, 2))
    held = np.concatenate([nearest[dense], farthest[dense]]), np.concatenate([dense, dense])
    return tuple(map(np.concatenate, zip(*found, strict=True))), held


def window_links(
    groups: np.ndarray, vectors: np.ndarray, carried: int, window: int, cosine: float
) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of ``window_pairs``."""
    return window_pairs(groups, vectors, carried, window, cosine)[0]


def _pass_links(distinct: DataFrame, turns: list[int], window: int, cosine: float, seed: int) -> DataFrame:
    """Spanning links (``a``, ``b``) found in some passes, and those of dense stretches (``dense``)."""

    def worded(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            sizes = np.array(batch["size"], np.int64)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size).tolist()
                matrix = np.array([batch["unit"][i] for i in rows])
                for turn in turns:
                    yield {
                        "turn": [turn] * len(rows),
                        "size": [size] * len(rows),
                        "word": words(matrix, turn, seed),
                        "node": [batch["node"][i] for i in rows],
                        "unit": [batch["unit"][i] for i in rows],
                    }

    def compared(batches: Iterator[dict]) -> Iterator[dict]:
        held: tuple[list, list, list] = ([], [], [])
        carried = 0

        def solve() -> dict:
            sizes = np.array(list(map(len, held[2])))
            out: dict[str, list] = {"a": [], "b": [], "dense": []}
            nodes = np.array(held[1], np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                matrix = np.array([held[2][i] for i in rows])
                turn = np.array(held[0])[rows]
                pairs = window_pairs(turn, matrix, int((rows < carried).sum()), window, cosine)
                for (a, b), dense in zip(pairs, (False, True), strict=True):
                    linked, to = _spanning(len(rows), a, b)
                    out["a"] += nodes[rows[linked]].tolist()
                    out["b"] += nodes[rows[to]].tolist()
                    out["dense"] += [dense] * len(linked)
            return out

        for batch in batches:
            for column, name in zip(held, ("turn", "node", "unit"), strict=True):
                column.extend(batch[name])
            if len(held[0]) >= CHUNK:
                yield solve()
                held = tuple(column[-window:] for column in held)
                carried = len(held[0])
        if len(held[0]) > carried:
            yield solve()

    wide = arrow_map(distinct, "turn int, size int, word long, node long, unit array<double>", worded)
    order = ["turn", "size", "word", "node"]
    ordered = wide.repartitionByRange(*order).sortWithinPartitions(*order)
    return arrow_map(ordered, "a long, b long, dense boolean", compared)


def _dense_links(distinct: DataFrame, groups: DataFrame, cosine: float, block: int) -> DataFrame:
    """Spanning links (``a``, ``b``) of all pairs inside each group (``node``, ``root``).

    A group is cut into parts of about ``block`` vectors; a task gets two parts at a time, or one to compare with itself.
    """
    parts = groups.groupBy("root").agg(F.expr(f"(count(*) - 1) div {block} + 1").alias("parts"))
    placed = distinct.select("node", "unit").join(groups, "node").join(parts, "root")
    part = F.pmod(F.xxhash64("node", "root"), "parts").alias("part")
    dealt = placed.select("root", "node", "unit", part, F.explode(F.expr("sequence(0L, parts - 1)")).alias("other"))
    cell = ["root", "low", "high"]
    dealt = dealt.select(
        "root", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "unit"
    )

    def compared(batches: Iterator[dict]) -> Iterator[dict]:
        now, nodes, parts, units = None, [], [], []

        def solve() -> Iterator[dict]:
            names, matrix = np.array(nodes, np.int64), np.array(units)
            cut = len(parts) if now[1] == now[2] else parts.index(now[2]) if now[2] in parts else len(parts)
            right = 0 if now[1] == now[2] else cut
            label = np.arange(len(names))
            for start in range(0, cut, BLOCK // 2):
                a, b = np.nonzero(matrix[start : min(cut, start + BLOCK // 2)] @ matrix[right:].T >= cosine)
                merge_classes(label, a + start, b + right)
            linked = np.flatnonzero(label != np.arange(len(names)))
            yield {"a": names[linked].tolist(), "b": names[label[linked]].tolist()}

        for batch in batches:
            for root, low, high, own, node, vector in zip(*batch.values(), strict=True):
                if now != (root, low, high):
                    if nodes:
                        yield from solve()
                    now, nodes, parts, units = (root, low, high), [], [], []
                nodes.append(node)
                parts.append(own)
                units.append(np.array(vector))
        if nodes:
            yield from solve()

    ordered = dealt.repartition(*cell).sortWithinPartitions(*cell, "part")
    return arrow_map(ordered, "a long, b long", compared)


def _degrees(members: DataFrame, cosine: float, block: int) -> DataFrame:
    """(``node``, ``weight``): rows linked to each vector of a component, itself left out.

    ``members`` has ``root``, ``node``, ``times`` and ``unit`` of components of several vectors.
    """
    limit = math.acos(cosine)
    pivots = members.where("node = root").select("root", F.col("unit").alias("pivot"))

    def angles(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            cosines = [
                float(np.dot(x, y)) if len(x) == len(y) else -1.0
                for x, y in zip(batch["unit"], batch["pivot"], strict=True)
            ]
            yield {n: batch[n] for n in ("root", "node", "times", "unit")} | {
                # With room for rounding: such pairs have a cosine above the limit beyond doubt.
                "inner": [math.acos(min(1.0, c)) <= limit / 2 - 1e-6 for c in cosines]
            }

    layout = "root long, node long, times long, unit array<double>, inner boolean"
    placed = materialised(arrow_map(members.join(pivots, "root"), layout, angles))
    sizes = placed.groupBy("root").agg(
        F.sum(F.when(F.col("inner"), F.col("times"))).alias("core"),
        F.count("*").alias("n"),
        F.count(F.when(~F.col("inner"), 1)).alias("n_outer"),
    )
    sizes = materialised(sizes)
    certain = placed.where("inner").join(sizes, "root").select("node", (F.col("core") - 1).alias("weight"))
    cut = sizes.where("n_outer > 0").select(
        "root", F.expr(f"(n - 1) div {block} + 1").alias("cols"), F.expr(f"(n_outer - 1) div {block} + 1").alias("rows")
    )
    cells = placed.join(cut, "root")
    spread = F.xxhash64("node", "root")
    everyone = cells.withColumn("col", F.pmod(spread, "cols")).select(
        "root", F.explode(F.expr("sequence(0L, rows - 1)")).alias("row"), "col", F.lit(False).alias("outer"), "node", "times", "unit", "inner"
    )
    outer = cells.where("not inner").withColumn("row", F.pmod(spread, "rows")).select(
        "root", "row", F.explode(F.expr("sequence(0L, cols - 1)")).alias("col"), F.lit(True).alias("outer"), "node", "times", "unit", "inner"
    )

    def counted(batches: Iterator[dict]) -> Iterator[dict]:
        cell, left, right = None, [], []

        def solve() -> dict:
            x, y = np.array([r[2] for r in left]), np.array([r[2] for r in right])
            linked = (x @ y.T >= cosine) if len(left) and len(right) else np.zeros((len(left), len(right)), bool)
            linked &= np.array([r[0] for r in left], np.int64)[:, None] != np.array([r[0] for r in right], np.int64)[None, :]
            out = [(r[0], int(w)) for r, w in zip(left, linked @ np.array([r[1] for r in right], np.int64), strict=True)]
            # Members near the pivot learn of the outer ones here; outer ones have counted each other already.
            times = np.array([r[1] for r in left], np.int64)
            out += [(r[0], int(w)) for r, w in zip(right, times @ linked, strict=True) if r[3]]
            return {"node": [o[0] for o in out], "weight": [o[1] for o in out]}

        for batch in batches:
            for root, row, col, is_outer, node, times, vector, inner in zip(*batch.values(), strict=True):
                if cell != (root, row, col):
                    if left:
                        yield solve()
                    cell, left, right = (root, row, col), [], []
                (left if is_outer else right).append((node, times, vector, inner))
        if left:
            yield solve()

    key = ["root", "row", "col"]
    dealt = everyone.unionByName(outer).repartition(*key).sortWithinPartitions(*key, "outer")
    own = placed.where("not inner").select("node", (F.col("times") - 1).alias("weight"))
    partial = arrow_map(dealt, "node long, weight long", counted)
    return certain.unionByName(own).unionByName(partial).groupBy("node").agg(F.sum("weight").alias("weight"))


def near_duplicates(
    vectors: DataFrame,
    cosine: float = COSINE,
    passes: int = PASSES,
    window: int = WINDOW,
    seed: int = SEED,
    block: int = BLOCK,
    dense_block: int = DENSE_BLOCK,
) -> DataFrame:
    """One row per row of ``vectors`` (``vec_id``, ``embedding``): ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    ``n_links`` counts the other rows with a cosine of at least ``cosine`` among the component found, ``component_id`` is the
    smallest ``vec_id`` reachable, ``kept`` says whether the row has that id. Vectors that are null, zero, or hold null or
    non-finite parts link with nothing, not even with equal ones; vectors of different lengths are not
    compared. A null ``vec_id`` names no component: if a component has no other id it is null. Rows of one id stay rows
    of their own. Equal vectors are compared once. Other columns are ignored; an empty table gives an empty result.
    """
    rows, distinct = _distinct(vectors)
    found = None
    for start in range(0, passes, PASSES_AT_ONCE):
        turns = list(range(start, min(passes, start + PASSES_AT_ONCE)))
        links = materialised(_pass_links(distinct, turns, window, cosine, seed))
        found = links if found is None else found.unionByName(links)
    dense = connected(found.where("dense"))
    found = found.where("not dense").select("a", "b")
    if not dense.isEmpty():
        dense = materialised(dense)
        found = found.unionByName(materialised(_dense_links(distinct, dense, cosine, dense_block)))
    groups = materialised(connected(found))
    roots = groups.select("node", "root")
    members = distinct.join(roots, "node").select("root", "node", "times", "unit")
    degrees = _degrees(members, cosine, block)
    named = distinct.select("node", "times", "least").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    named = materialised(named)
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = (
        named.join(smallest, "root")
        .join(degrees, "node", "left")
        .select("node", "component_id", F.coalesce("weight", F.col("times") - 1).alias("n_links"))
    )
    joined = rows.join(materialised(facts), "node", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
