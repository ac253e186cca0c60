import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parcelwise.llm import line_dedup

SEPARATORS = re.compile(r"[\s!-/:-@\[-`{-~]+", re.ASCII)


def simhash(words, alone=None):
    words = [w for w in words if len(w) > 3]
    if not words:
        return alone
    ones = np.zeros(64, int)
    for w in words:
        value = xxhash.xxh64_intdigest(w, 42)
        ones += [value >> i & 1 for i in range(64)]
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(words))


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def brute(docs):
    """Lines that stay per document id, from all pairs of lines."""
    lines = [(d, i, [w for w in SEPARATORS.split(t.lower()) if w]) for d, text in docs for i, t in enumerate(text.split("\n"))]
    own = random.Random(5)
    alone = defaultdict(lambda: own.getrandbits(64))
    judged = [(d, i, w, simhash(w, alone[tuple(w)])) for d, i, w in lines if len(w) >= 5]
    root = list(range(len(judged)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(judged)):
        for b in range(a):
            x, y = judged[a], judged[b]
            if (x[3] ^ y[3]).bit_count() <= 3 and edits(x[2], y[2]) <= 0.2 * max(len(x[2]), len(y[2])) + 1e-9:
                root[max(find(a), find(b))] = min(find(a), find(b))
    gone = {judged[a][:2] for a in range(len(judged)) if find(a) != a}
    return {d: "\n".join(t for i, t in enumerate(text.split("\n")) if (d, i) not in gone) for d, text in docs}


def result(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


@pytest.mark.parametrize("neighbours", [0, 4])
def test_like_all_pairs(documents, session, small, monkeypatch, neighbours):
    monkeypatch.setattr(line_dedup, "NEIGHBOURS", neighbours)
    given = [(r["doc_id"], r["text"]) for r in session.read.parquet(f"{small}/documents.parquet").collect()]
    base = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa"
    words = base.split()
    variants = [" ".join(words[:k] + [f"word{k}"] + words[k + 1 :]) for k in range(len(words))]
    given += [(9_000 + i, "to be or not to be\nis it so or is it me") for i in range(3)]
    given += [(10_000 + i, f"Own line number {i} of this very text.\n{v}") for i, v in enumerate(variants * 3)]
    given.sort()
    assert result(line_dedup.deduplicated(documents(*given))) == brute(given)


@pytest.mark.parametrize("words", [5, 126, 127, 128, 300])
def test_hash_of_long_lines(documents, words):
    text = " ".join(f"w{i % 97}x{i % 31}" for i in range(words))
    (row,) = line_dedup.hashed_lines(documents((1, text))).collect()
    assert row["fp"] & (2**64 - 1) == simhash(text.split())


def test_edge_cases(documents):
    line = "One line of some seven words here"
    rows = [
        (None, line, "en", "s", 1),
        (3, f"{line}\n\nshort\nshort", "en", "s", 1),
        (3, "another text under the same id, long enough", "en", "s", 1),
        (2, f"{line.upper()}!\n{line}", None, None, None),
        (5, None, "en", "s", 0),
        (6, "", "en", "s", 0),
        (6, "", "en", "s", 0),
    ]
    found = line_dedup.deduplicated(documents(*rows))
    assert found.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(((r[0], r[1], r[4], *r["_lines"]) for r in found.collect()), key=repr) == sorted(
        [
            (None, "", 0, 1, 1),
            (3, "\nshort\nshort", 12, 4, 1),
            (3, "another text under the same id, long enough", 43, 1, 0),
            (2, line.upper() + "!", len(line) + 1, 2, 1),
            (5, None, None, 0, 0),
            (6, "", 0, 1, 0),
            (6, "", 0, 1, 0),
        ],
        key=repr,
    )
    assert line_dedup.deduplicated(documents(*rows).limit(0)).count() == 0


def test_clashing_names(documents):
    docs = documents((1, "the same five words here"), (2, "the same five words here")).withColumn("h", F.lit(1))
    docs = docs.withColumn("line", F.lit("x")).withColumn("words", F.lit(2)).withColumn("first", F.lit(3))
    assert result(line_dedup.deduplicated(docs)) == {1: "the same five words here", 2: ""}


@pytest.mark.parametrize("max_bits", [0, 1, 3, 6])
def test_buckets_are_one_number(session, max_bits):
    rnd = random.Random(max_bits)
    hashes = [rnd.getrandbits(64) for _ in range(200)]
    hashes += [h ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, max_bits + 3))) for h in hashes]
    signed = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)]
    members = line_dedup._bucket_members(session.createDataFrame(signed, "h long, fp long"), max_bits)
    assert members.columns == ["bucket", "h", "fp", "n", "near"]
    cuts = [64 * k // (max_bits + 2) for k in range(max_bits + 3)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    expected = defaultdict(set)
    for i, h in enumerate(hashes):
        for number, (x, y) in enumerate(combinations(masks, 2)):
            expected[number, h & (x | y)].add(i)
    found = defaultdict(set)
    for r in members.collect():
        found[r["bucket"]].add(r["h"])
        assert r["n"] > 1
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)
    linked = {frozenset((r["h"], x)) for r in members.collect() for x in r["near"]}
    assert all((hashes[a] ^ hashes[b]).bit_count() <= max_bits for a, b in linked)
    # All pairs within the bound share a bucket, and only one of their buckets counts as the first.
    pairs = [(a, b) for a in range(400) for b in range(a) if (hashes[a] ^ hashes[b]).bit_count() <= max_bits]
    rows = session.createDataFrame([(signed[a][1], signed[b][1]) for a, b in pairs] or [(1, 1)], "fp long, other long")
    assert rows.where(line_dedup._first_shared("fp", "other", max_bits).isNull()).isEmpty()


def test_buckets_are_sorted_without_comparisons(session):
    nodes = session.createDataFrame([(1, 2), (2, 2)], "h long, fp long")
    plans = []
    wrapped = lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or df
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(line_dedup, "materialised", wrapped)
        line_dedup._bucket_members(nodes, 3)
    counted = [line for line in plans[0].split("\n") if "Window [count(1)" in line]
    assert len(counted) == 1 and re.search(r"\[bucket#\d+L\]$", counted[0])


def test_separators(session):
    text = "".join(map(chr, range(1, 0x250))) + "a\u00a0b\u2028c\u2014d"
    words = session.createDataFrame([(text,)], "line string").select(line_dedup._words("line")).first()[0]
    assert words == [w for w in SEPARATORS.split(text.lower()) if w]


def test_no_python(documents):
    plan = line_dedup.deduplicated(documents((1, "a b c d e f")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
