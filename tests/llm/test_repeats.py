import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.llm import repeats


def brute(texts, length):
    """Maximal removed spans of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    found = []
    for d in data:
        gone = bytearray(len(d) + 1)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        edges = [i for i in range(len(d) + 1) if gone[i] != (gone[i - 1] if i else 0)]
        found.append(list(zip(edges[::2], edges[1::2], strict=True)))
    return found


def sample(seed, copies):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long = prose(40), prose(150)
    texts = [prose(rnd.randint(1, 60)) for _ in range(10)] + [long, long[50:], "x" + long, passage]
    for _ in range(copies):
        cut = rnd.randint(0, 40)
        texts.append(prose(rnd.randint(0, 30)) + passage[cut : rnd.randint(80, 200)] + prose(rnd.randint(0, 30)))
        at = rnd.randint(0, len(long))
        texts.append(long[:at] + word() + long[at + rnd.randint(0, 3) :])
    return [*texts, None, "", "a" * 900, "ab" * 300, passage + " " + passage, texts[0]]


@pytest.mark.parametrize("large", [1, 3000, 1 << 20])
@pytest.mark.parametrize("length", [64, 100])
def test_like_brute_force(documents, large, length):
    texts = sample(length, 25)
    rows = list(enumerate(texts))
    found = repeats.without_repeats(documents(*rows).repartition(3), length, 2000, large).collect()
    expected = brute(texts, length)
    assert len(found) == len(texts)
    for r in found:
        data, spans = (texts[r["doc_id"]] or "").encode(), expected[r["doc_id"]]
        assert [tuple(x) for x in r["spans"]] == spans
        assert r["n_bytes"] == len(data)
        edges = [0, *(x for s in spans for x in s), len(data)]
        assert bytes(r["kept"]) == b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def test_index_is_run_length_and_exact():
    rnd = random.Random(3)
    base = bytes(rnd.choice(b"abc") for _ in range(300))
    texts = [base[: rnd.randint(100, 300)] + bytes([rnd.choice(b"xyz")]) + base[rnd.randint(0, 200) :] for _ in range(30)]
    index = repeats.RunLengthIndex(texts)
    assert index.runs < index.total / 3
    found = index.matching_statistics()
    where = [(t, i) for t, text in enumerate(texts) for i in range(len(text))]
    position = {x: int(index.starts[x[0]]) + x[1] for x in where}
    for t, i in rnd.sample(where, 150):
        mine = texts[t][i:]
        best = 0
        for u, j in where:
            if (u, j) != (t, i):
                other = texts[u][j:]
                while best < min(len(mine), len(other)) and mine[: best + 1] == other[: best + 1]:
                    best += 1
        assert found[position[t, i]] == best


def suffixes(texts):
    joined = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    left = np.repeat(ends, [len(t) + 1 for t in texts]) - np.arange(len(joined))
    return joined, left, repeats.RunLengthIndex._suffixes(joined, left)


def test_suffixes_sort_values_only(monkeypatch):
    rnd = random.Random(11)
    base = bytes(rnd.choice(b"ab\0") for _ in range(120))
    texts = [b"", b"a", *(base[rnd.randint(0, 60) : rnd.randint(60, 120)] for _ in range(20)), base, b"a" * 90, bytes(range(256))]
    # Blocks of ordinary size need no index sort, which costs several times as much.
    monkeypatch.setattr(np, "argsort", None)
    joined, left, order = suffixes(texts)
    whole = joined.tobytes()
    assert order.tolist() == sorted(range(len(whole)), key=lambda i: ([c + 1 for c in whole[i : i + left[i]]] + [0], i))


def test_suffixes_of_a_large_block():
    rnd = np.random.default_rng(4)
    base = rnd.integers(97, 101, 900_000).astype(np.uint8).tobytes()
    joined, left, order = suffixes([base, base[1000:], base[:500_000] + b"x"])
    n = len(joined)
    assert n > 1 << 21 and np.array_equal(np.sort(order), np.arange(n))
    whole = joined.tobytes()
    for i in rnd.integers(0, n - 1, 300):
        a, b = order[i], order[i + 1]
        assert (whole[a : a + left[a]], a) < (whole[b : b + left[b]], b)


def test_segments_do_not_matter(documents, monkeypatch):
    texts = sample(9, 10)
    monkeypatch.setattr(repeats, "SEGMENT", 150)
    runs = [list(repeats.anchored_runs((t or "").encode(), 64)) for t in texts if len((t or "").encode()) >= 64]
    for found in runs:
        assert found[0][0] == 0 and all(a[1] + 1 == b[0] for a, b in zip(found, found[1:], strict=False))
        assert all(s <= a <= e + 64 - 32 and e <= a for s, e, a, _ in found)


def test_edge_cases(documents):
    text = "word " * 10 + "".join(chr(97 + i * i % 26) for i in range(500))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, "short", None, None, None), (2, None, "en", "s", 0)]
    docs = documents(*rows).withColumn("spans", F.lit(1)).withColumn("k", F.lit(2)).withColumn("_x", F.lit(3))
    found = sorted(((r["doc_id"], r["n_bytes"], len(bytes(r["kept"]))) for r in repeats.without_repeats(docs).collect()), key=str)
    assert found == [(1, len(text), 0), (1, len(text), 0), (2, 0, 0), (None, 5, 5)]
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_smallest():
    keys = np.random.default_rng(1).integers(0, 1 << 60, 500).astype(np.uint64)
    for width in (1, 2, 33, 369):
        assert repeats._smallest(keys, width).tolist() == [keys[i : i + width].min() for i in range(501 - width)]
