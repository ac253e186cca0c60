import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.llm import embedding


@pytest.fixture(scope="module")
def vectors(session):
    return lambda rows: session.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(rows, cosine):
    """Links and component of each row, from all pairs; invalid rows alone."""
    units = [embedding.unit(v) for _, v in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, u in enumerate(units):
        for j in range(i):
            if u is not None and units[j] is not None and len(u) == len(units[j]) and float(u @ units[j]) >= cosine:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[i][0]: (links[i], min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))) for i in range(len(rows))}


def clouds(seed, spread, sizes, dims=24):
    rnd = np.random.default_rng(seed)
    rows = []
    for n in sizes:
        center = rnd.standard_normal(dims)
        for _ in range(n):
            rows.append((center + spread * np.linalg.norm(center) * rnd.standard_normal(dims) / math.sqrt(dims)).tolist())
    rows += rnd.standard_normal((40, dims)).tolist()
    ids = rnd.permutation(len(rows)).tolist()
    return [(i, np.array(v, np.float32).tolist()) for i, v in zip(ids, rows, strict=True)]


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("spread", [0.05, 0.15])
def test_tight_groups_are_whole(vectors, spread):
    rows = clouds(1, spread, [1, 2, 3, 150, 40])
    rows += [(1000 + i, rows[3][1]) for i in range(5)]
    found = embedding.near_duplicates(vectors(rows).repartition(3), window=8, block=16).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == brute(rows, 0.95)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_recall_near_the_limit(vectors):
    rows = clouds(2, 0.22, [30, 60, 5])
    found, expected = result(embedding.near_duplicates(vectors(rows), block=16)), brute(rows, 0.95)
    assert all(found[i][0] <= expected[i][0] for i in expected)
    assert sum(f[0] for f in found.values()) >= 0.95 * sum(e[0] for e in expected.values())


def test_window_links():
    x = np.array([[1.0, 0], [0, 1], [1, 0], [1, 0], [0, 1]])
    groups = np.array([0, 0, 0, 1, 1])
    pairs = lambda *a: sorted(zip(*map(np.ndarray.tolist, embedding.window_links(groups, x, *a)), strict=True))
    assert pairs(0, 4, 0.9) == [(0, 2)]
    assert pairs(0, 1, 0.9) == [] and pairs(3, 4, 0.9) == []


def test_edge_cases(session):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [0.0, 0.0]), (7, [nan, 1.0]),
        (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [1e300, 0.0]), (None, [1.0, 0.0]),
        (None, [0.0, 5.0]), (12, [-1.0, 0.0]), (13, [0.0, 0.0, 7.0]), (13, [0.0, 0.0, 7.0]),
    ]
    df = session.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, node int, root string")
    found = sorted(((r[0] if r[0] is not None else -1, *list(r)[1:]) for r in embedding.near_duplicates(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 12)]
    expected = [(1, 3, 1, True), (2, 3, 1, False), (11, 3, 1, False), (-1, 3, 1, False), (-1, 0, None, False)]
    assert found == sorted([*alone, *expected, (13, 1, 13, True), (13, 1, 13, True)], key=str)
    assert embedding.near_duplicates(df.limit(0)).count() == 0
