from collections import Counter

import corpus_pipeline
from parcelwise.llm import mixing
from parcelwise.llm.queries import WEIGHTS
from parcelwise.session import materialised


def test_tokens_tell_the_mix(session, documents, small):
    counts = {"src0": 320} | {f"src{i}": 48 for i in range(1, 20)}
    rows = [(i, f"text {i} of {s}", "en", s, 9) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    source = {r[0]: r[3] for r in rows}
    written = materialised(corpus_pipeline.mix_sources(session, documents(*rows), small))
    found = corpus_pipeline.encode(session, written.repartition(7), small).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(source)
    assert len({r["position"] for r in found}) == len(rows)
    # The order is the one the mixing stage decided on, and sources hold their shares at every point of it.
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["position"])]
    placed = mixing.scheduled(documents(*rows), WEIGHTS).select("doc_id", "_mix.position").collect()
    assert order == [r["doc_id"] for r in sorted(placed, key=lambda r: r["position"])]
    slots = mixing.whole_weights(WEIGHTS | {None: min(WEIGHTS.values())})
    total, seen, left = sum(slots[s] for s in counts), Counter(), {s: n // 16 for s, n in counts.items()}
    of_slot = {r["slot"]: source[r["doc_id"]] for r in found}
    for slot in range(len(of_slot)):
        seen[of_slot[slot]] += 1
        assert all(abs(seen[s] - (slot + 1) * slots[s] / total) < 1 for s in counts)
        if seen[of_slot[slot]] == left[of_slot[slot]]:
            break
    assert slot > 50


def test_places_are_those_the_mixing_stage_decided(session, documents, small, monkeypatch):
    docs = documents(*[(i, f"text {i}", "en", f"src{i % 3}", 6) for i in range(200)])
    monkeypatch.setattr(corpus_pipeline, "WEIGHTS", {"src0": 1.0, "src1": 5.0, "src2": 2.0})
    written = materialised(corpus_pipeline.mix_sources(session, docs, small))
    expected = mixing.scheduled(docs, corpus_pipeline.WEIGHTS).select("doc_id", "_mix.slot", "_mix.position").collect()
    monkeypatch.undo()
    found = corpus_pipeline.encode(session, written.repartition(5), small).select("doc_id", "slot", "position").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, expected))
    # Without the mixing stage there are no places.
    unmixed = corpus_pipeline.encode(session, docs, small).select("slot", "position").distinct().collect()
    assert [tuple(row) for row in unmixed] == [(None, None)]
