import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parcelwise.llm import simhash


def plain_fingerprint(text, words=3):
    found = [w for w in (text or "").encode().lower().replace(b"\v", b" ").split()]
    if not found:
        return 0
    parts = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [b" ".join(found)]
    values = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(v >> i & 1 for v in values) > len(values))


def components(fingerprints, max_bits):
    """Smallest position reachable over pairs within ``max_bits``, from all pairs."""
    root = list(range(len(fingerprints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, x in enumerate(fingerprints):
        for j in range(i):
            if (x ^ fingerprints[j]).bit_count() <= max_bits:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fingerprints))]


def cloud(seed, n, flips):
    rnd = random.Random(seed)
    centers = [rnd.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    found = []
    for _ in range(n):
        value = rnd.choice(centers)
        for _ in range(rnd.randint(0, flips)):
            value ^= 1 << rnd.randrange(64)
        found.append(value)
    return found


@pytest.mark.parametrize("text", ["", " \t\n", "one", "One  TWO", "a b c d a b c d", "É É É x y Z", "a\x1cb c d e f"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_long_text(monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 7)
    text = " ".join(f"w{i % 13}" for i in range(200))
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("pairs_at_once", [8, 500_000])
@pytest.mark.parametrize("max_bits", [0, 1, 3])
def test_trie_finds_all_links_within_groups(monkeypatch, max_bits, pairs_at_once):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", pairs_at_once)
    values = np.unique(np.array(cloud(1, 300, 4), np.uint64))
    group = np.sort(np.random.default_rng(1).integers(0, 3, len(values)))
    label = simhash.trie_links(group, values, max_bits)
    for g in range(3):
        at = np.flatnonzero(group == g)
        assert [at[i] for i in components([int(v) for v in values[at]], max_bits)] == label[at].tolist()


@pytest.mark.parametrize("large", [1, 10, 20_000])
def test_links_of_distributed_tries(session, large):
    values = sorted(set(cloud(2, 600, 6)))
    df = session.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    edges = {(r["a"], r["b"]) for r in simhash.linked_fingerprints(df, 3, large).collect()}
    root = {simhash._signed(v): simhash._signed(v) for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 64
        root[find(a)] = find(b)
    expected = components(values, 3)
    mine = [find(simhash._signed(v)) for v in values]
    assert len(set(zip(mine, expected, strict=True))) == len(set(mine)) == len(set(expected))


def test_documents_like_all_pairs(session, small):
    docs = session.read.parquet(f"{small}/documents.parquet")
    given = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    prints = [plain_fingerprint(t) for _, t in given]
    expected = {given[i][0]: (f"{prints[i]:016x}", given[c][0]) for i, c in enumerate(components(prints, 3))}
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert found == expected
    kept = {r["doc_id"] for r in simhash.one_per_component(docs).collect()}
    assert kept == {c for _, c in expected.values()}


def test_edge_cases(documents):
    rows = [(4, "x y z"), (2, "X  y\tZ"), (None, "x y z"), (7, None), (8, ""), (9, " \n"), (4, "other words entirely here"), (4, "x y z")]
    docs = documents(*rows).withColumn("fp", F.lit("own")).withColumn("root", F.lit(1))
    found = sorted(((r["doc_id"], r["component_id"], r["fingerprint"] == "0" * 16) for r in simhash.near_duplicates(docs).collect()), key=str)
    expected = [(4, 2, False), (2, 2, False), (None, 2, False), (7, 7, True), (8, 7, True), (9, 7, True), (4, 4, False), (4, 2, False)]
    assert found == sorted(expected, key=str)
    kept = simhash.one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [2, 4, 7, None]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_over_long_chains(session):
    from parcelwise.llm.shared import connected

    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (7, 3), (3, 9), (None, 1)]
    found = {r["node"]: r["root"] for r in connected(session.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {3: 3, 7: 3, 9: 3}
