from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parcelwise.llm import mixing


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 2, "c": 5}, {"a": 997, "b": 2, "c": 1}, {"a": 333, "b": 334, "c": 333}])
def test_every_block_meets_its_window(weights):
    pattern = mixing.earliest_deadline_first(weights)
    period, seen = len(pattern), defaultdict(int)
    assert period == sum(weights.values())
    for slot, (s, k) in enumerate(pattern):
        release, deadline = mixing.windows(weights[s], period, k)
        assert k == seen[s] and release <= slot < deadline
        seen[s] += 1
        assert all(abs(seen[x] - (slot + 1) * w / period) < 1 for x, w in weights.items())


def test_whole_weights():
    found = mixing.whole_weights({"a": 0.7, "b": 0.2999, "c": 1e-9}, 100)
    assert sum(found.values()) == 100 and found["c"] == 1 and found["a"] > found["b"]
    with pytest.raises(ValueError):
        mixing.whole_weights({"a": 0.0})


def slot_by_slot(blocks, weights):
    """The mix by plain simulation: the pattern starts anew whenever a source runs out."""
    left, given, order = dict(blocks), defaultdict(int), []
    left = {s: n for s, n in left.items() if n}
    while left:
        pattern, at = mixing.earliest_deadline_first({s: weights[s] for s in left}), 0
        while True:
            s = pattern[at % len(pattern)][0]
            order.append((s, given[s]))
            given[s] += 1
            left[s] -= 1
            at += 1
            if not left[s]:
                del left[s]
                break
    return order


@pytest.mark.parametrize("counts", [(100, 7, 33), (1, 1, 1), (0, 50, 0), (64, 64, 64), (5, 500, 0)])
def test_rows_follow_the_schedule(documents, counts):
    rows = [(i * 10 + s, f"text {i}", "en", f"src{s}" if s else None, 6) for s, n in enumerate(counts) for i in range(n)]
    docs = documents(*rows)
    weights = {"src1": 5, "src2": 3, None: 2}
    found = mixing.scheduled(docs, weights, block_rows=4, period=20, slices=5).select("doc_id", "source", "_mix.*").collect()
    assert sorted(r["doc_id"] for r in found) == sorted(r[0] for r in rows)
    slots = {}
    for r in found:
        assert slots.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
        assert r["release"] <= r["slot"] < r["deadline"]
    blocks = {s: -(-n // 4) for s, n in zip((None, "src1", "src2"), counts)}
    expected = slot_by_slot(blocks, mixing.whole_weights(weights, 20))
    assert [slots[i] for i in range(len(slots))] == expected
    assert len({r["position"] for r in found}) == len(found)
    sizes = defaultdict(int)
    for r in found:
        sizes[r["slot"]] += 1
    assert max(sizes.values(), default=0) <= 4


def test_written_order_and_edge_cases(documents, session, tmp_path):
    rows = [(i if i % 7 else None, None if i % 5 == 0 else f"t{i % 3}", "en", f"s{i % 4}", 1) for i in range(200)]
    docs = documents(*rows).withColumn("block", F.lit("own")).withColumn("slot", F.lit(1))
    out = mixing.mixed(docs, {"s0": 0.6, "s1": 0.4})
    assert out.columns == docs.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    assert mixing.mixed(docs.limit(0), {"s0": 1.0}).count() == 0
