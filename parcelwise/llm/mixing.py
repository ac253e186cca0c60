"""Mixing sources to target weights by Pfair scheduling of source blocks.

Rows of a source are shuffled by a seeded hash and cut into blocks of ``block_rows``. The schedule gives one slot to one
block at a time. With weight w (a whole number of slots in a period of P slots) block k of a source is released
at slot floor(k P / w) and due before slot ceil((k + 1) P / w). In every slot the released block with the earliest
deadline goes first. As the weights fill the period exactly, every block meets its window, and so at any moment
a source has received its target share to within less than one block.

The pattern repeats after a period, so one period is scheduled on the driver, whose size the weights fix, and a
block's slot follows from its number. When a source has no blocks left, the remaining ones share the slots by their
weights from there on: a new phase. All rows are placed, none is dropped or repeated.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.session import materialised

# Weights are rounded to parts of this many slots.
PERIOD = 1000
# Rows of sources without a weight of their own, and of no source.
REST = None


def whole_weights(weights: Mapping[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Slots per period for each source, at least one each, by largest remainders (ties by name)."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    if len(weights) > period:
        raise ValueError("a period needs a slot for every source")
    names = sorted(weights, key=lambda s: (s is not None, s or ""))
    spare, total = period - len(names), sum(weights.values())
    exact = {s: weights[s] / total * spare for s in names}
    slots = {s: 1 + int(exact[s]) for s in names}
    short = period - sum(slots.values())
    for s in sorted(names, key=lambda s: (int(exact[s]) - exact[s], names.index(s)))[:short]:
        slots[s] += 1
    return slots


def windows(weight: int, period: int, k: int) -> tuple[int, int]:
    """Release and deadline of block ``k``: it must run in a slot from the first up to, but without, the second."""
    return k * period // weight, -(-(k + 1) * period // weight)


def earliest_deadline_first(weights: Mapping[str | None, int]) -> list[tuple[str | None, int]]:
    """The (source, block) of every slot of one period."""
    period = sum(weights.values())
    order = {s: i for i, s in enumerate(sorted(weights, key=lambda s: (s is not None, s or "")))}
    waiting = [(0, order[s], s, 0) for s in weights]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str | None, int]] = []
    slots = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (windows(weights[s], period, k)[1], order[s], s, k))
        _, _, s, k = heapq.heappop(ready)
        slots.append((s, k))
        if k + 1 < weights[s]:
            heapq.heappush(waiting, (windows(weights[s], period, k + 1)[0], order[s], s, k + 1))
    return slots


@dataclass
class Phase:
    """A stretch of slots with one set of sources."""

    start: int
    weights: dict[str | None, int]
    first: dict[str | None, int]
    blocks: dict[str | None, int] = field(default_factory=dict)
    place: dict[str | None, list[int]] = field(default_factory=dict)


def phases(blocks: Mapping[str | None, int], weights: Mapping[str | None, int]) -> list[Phase]:
    """The phases of a mix of ``blocks`` per source: each ends with the slot in which a source runs out."""
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    found, slot = [], 0
    while left:
        phase = Phase(slot, {s: weights[s] for s in left}, {s: done[s] for s in left})
        pattern = earliest_deadline_first(phase.weights)
        for at, (s, _) in enumerate(pattern):
            phase.place.setdefault(s, []).append(at)
        rounds = min((left[s] - 1) // phase.weights[s] for s in left)
        taken = {s: rounds * phase.weights[s] for s in left}
        slot += rounds * len(pattern)
        for s, _ in pattern:
            taken[s] += 1
            slot += 1
            if taken[s] == left[s]:
                break
        phase.blocks = taken
        found.append(phase)
        for s, n in taken.items():
            done[s] += n
        left = {s: n - taken[s] for s, n in left.items() if n > taken[s]}
    return found


@dataclass(frozen=True)
class Plan:
    """What a mix has decided: slots per period and blocks of every source, rows of a block, and the seed of the order."""

    slots: dict[str | None, int]
    blocks: dict[str | None, int]
    block_rows: int
    seed: int

    def text(self) -> str:
        return json.dumps([[[s, n, self.blocks[s]] for s, n in self.slots.items()], self.block_rows, self.seed])

    @classmethod
    def of(cls, text: str) -> Plan:
        sources, block_rows, seed = json.loads(text)
        return cls({s: n for s, n, _ in sources}, {s: n for s, _, n in sources}, block_rows, seed)


# Metadata of ``source`` that names the plan of a mix; written files keep it, whatever becomes of the order of rows.
PLAN = "mix"


def planned(docs: DataFrame) -> Plan | None:
    """The plan by which ``docs`` were mixed; none if they were not."""
    text = docs.schema["source"].metadata.get(PLAN)
    return Plan.of(text) if text else None


def scheduled(
    docs: DataFrame,
    weights: Mapping[str | None, float],
    block_rows: int = 16,
    seed: int = 7,
    period: int = PERIOD,
    slices: int | None = None,
) -> DataFrame:
    """``docs`` and a struct ``_mix``: ``block``, ``phase``, ``release``, ``deadline``, ``slot``, ``position``.

    ``weights`` names the sources; all other rows (unnamed and null sources) are one more source under the key
    ``None``, which may have a weight too and else gets the smallest one. ``release``, ``deadline`` and ``slot`` count from the
    start of the mix; ``position`` orders the rows of the whole mix (gaps after the last, shorter block of a source). The
    order inside a source depends on the seed, ``doc_id`` and ``text`` only; rows alike in both are interchangeable. An
    empty table gives an empty result. A null text or id does no harm; other columns pass through.

    Ranks come from a range partitioning of all rows by source and hash, so a source that holds most rows is spread over
    many tasks. What reaches the driver has one entry per named source.
    """
    given = dict(weights)
    given.setdefault(REST, min(given.values()))
    return _placed(docs, whole_weights(given, period), None, block_rows, seed, slices)[0]


def placed(docs: DataFrame, plan: Plan) -> DataFrame:
    """As ``scheduled``, by a plan made before: ``docs`` are the rows that it was made for, in any order."""
    return _placed(docs, plan.slots, plan.blocks, plan.block_rows, plan.seed)[0]


def _placed(
    docs: DataFrame,
    slots_of: dict[str | None, int],
    blocks: dict[str | None, int] | None,
    block_rows: int,
    seed: int,
    slices: int | None = None,
) -> tuple[DataFrame, Plan]:
    """``docs`` with ``_mix``, and the plan; without ``blocks`` the rows are counted. Rows beyond a plan have no slot."""
    names = [s for s in slots_of if s is not None]
    numbers = {s: i for i, s in enumerate(names, 1)} | {REST: 0}
    number = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for s in names for x in (s, numbers[s])]), F.col("source").cast("string")),
        F.lit(0),
    )
    drawn = docs.select("*", number.alias("_s"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h"))
    ranged = drawn.repartitionByRange(*([slices] if slices else []), "_s", "_h", "doc_id")
    rows = materialised(
        ranged.sortWithinPartitions("_s", "_h", "doc_id").withColumn("_row", F.monotonically_increasing_id())
    )
    # The rows of a source in one partition are consecutive; each run starts after those of earlier partitions.
    runs = rows.groupBy("_s", F.shiftright("_row", 33).alias("_slice")).agg(
        F.min("_row").alias("_low"), F.count("*").alias("_n")
    )
    runs = materialised(runs)
    before = Window.partitionBy("_s").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_s", "_slice", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if blocks is None:
        sizes = {r["_s"]: r["n"] for r in rows.groupBy("_s").agg(F.count("*").alias("n")).collect()}
        blocks = {s: -(-sizes.get(i, 0) // block_rows) for s, i in numbers.items()}
    plan = phases(blocks, slots_of)
    spans = [
        (numbers[s], p.first[s], p.first[s] + n, i, p.start, p.weights[s], sum(p.weights.values()), p.place[s])
        for i, p in enumerate(plan)
        for s, n in p.blocks.items()
        if n
    ]
    layout = "_s int, lo long, hi long, phase int, start long, weight long, total long, place array<int>"
    session = docs.sparkSession
    # One list of spans per source; all spans together hold at most sources x period numbers.
    spans = session.createDataFrame(spans, layout).groupBy("_s").agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi", "phase", "start", "weight", "total", "place"))).alias("_spans")
    )
    ranked = (
        rows.withColumn("_slice", F.shiftright("_row", 33))
        .join(runs, ["_s", "_slice"])
        .withColumn("_rank", F.col("_before") + F.col("_row") - F.col("_low"))
        .withColumn("_block", F.expr(f"_rank div {block_rows}"))
        .join(F.broadcast(spans), "_s", "left")
        .withColumn("_span", F.expr("get(filter(_spans, x -> x.lo <= _block and _block < x.hi), 0)"))
        .withColumn("_k", F.expr("_block - _span.lo"))
    )
    slot = F.expr("_span.start + (_k div _span.weight) * _span.total + _span.place[cast(_k % _span.weight as int)]")
    mix = F.struct(
        F.col("_block").alias("block"),
        F.col("_span.phase").alias("phase"),
        F.expr("_span.start + (_k * _span.total) div _span.weight").alias("release"),
        F.expr("_span.start + ((_k + 1) * _span.total + _span.weight - 1) div _span.weight").alias("deadline"),
        slot.alias("slot"),
        (slot * block_rows + F.expr(f"_rank % {block_rows}")).alias("position"),
    )
    return ranked.select(*docs.columns, mix.alias("_mix")), Plan(slots_of, blocks, block_rows, seed)


def mixed(docs: DataFrame, weights: Mapping[str | None, float], block_rows: int = 16, seed: int = 7) -> DataFrame:
    """``docs`` in the order of the mix: partitions and rows ascend by position. Every row is kept.

    The column ``source`` carries the plan of the mix, by which ``placed`` gives the same places to the rows wherever they are.
    """
    given = dict(weights)
    given.setdefault(REST, min(given.values()))
    rows, plan = _placed(docs, whole_weights(given), None, block_rows, seed)
    ordered = rows.repartitionByRange("_mix.position").sortWithinPartitions("_mix.position")
    return ordered.select(*docs.columns).withMetadata("source", {PLAN: plan.text()})
