import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from parcelwise.llm import lexical, queries

TERM = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def terms(text):
    return re.findall(TERM, "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, top=10):
    """Every item against every document; rows are (id, text)."""
    counted = [(i, Counter(terms(text))) for i, text in docs]
    some = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(some), sum(n for _, _, n in some)
    df = Counter(t for _, c, _ in some for t in c)
    rows = []
    for item, text in items:
        scores = []
        for i, c, n in some:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms(text)
                if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        for rank, (score, missing, i) in enumerate(sorted(scores)[:top], 1):
            rows.append((item, rank, None if missing else i, -score))
    return sorted(rows, key=repr)


@pytest.fixture
def tables(session):
    def build(docs, items):
        return (
            session.createDataFrame(docs, "doc_id long, text string"),
            session.createDataFrame(items, "item_id long, text string"),
        )

    return build


def found(docs, items, **options):
    return sorted(map(tuple, lexical.search(docs, items, **options).collect()), key=repr)


def made(n, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    shares = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rng.choices(words, shares, k=rng.choice([3, 20, 80, 400])))) for i in range(n)]


@pytest.mark.parametrize("bucket", [4096, 16])
def test_like_scoring_every_document(tables, monkeypatch, bucket):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    docs = made(900)
    items = [(i, text) for i, text in made(25, seed=1)] + [(100, docs[7][1]), (101, "w1 w1 w1 W299"), (102, "unheard"), (103, None)]
    frames = tables(docs, items)
    assert found(frames[0].repartition(5), frames[1]) == plain(docs, items)


def test_ties_copies_nulls_and_empty_texts(tables):
    docs = [(i, "Same text, again!") for i in range(30, 0, -1)] + [(5, "same"), (None, "same text"), (None, None), (77, ""), (78, " .,;")]
    docs += [(900, "ÄH äh É é 1a-b"), (901, "x" * 10)]
    items = [(1, "same"), (1, "same"), (None, "text again"), (3, "äh É 1A"), (4, "")]
    frames = tables(docs, items)
    assert found(*frames) == plain(docs, items)
    assert found(*frames, top=3) == plain(docs, items, top=3)


def test_blocks_of_items_and_slices_of_texts(tables, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS_PER_BLOCK", 4)
    monkeypatch.setattr(lexical, "BYTES_PER_SLICE", 64)
    docs, items = made(200, seed=2), made(11, seed=3)
    assert found(*tables(docs, items)) == plain(docs, items)
    long = " ".join(["term"] * 5000 + ["rare"])
    assert {t.decode(): n for t, n in lexical.term_counts(long).items()} == Counter(terms(long))


def test_empty_tables_and_clashing_names(session, tables):
    docs, items = made(20), made(3, seed=4)
    assert found(*tables([], items)) == found(*tables(docs, [])) == found(*tables([(1, None)], items)) == []
    named = session.createDataFrame([(i, t, "a", 1.0, 2) for i, t in docs], "doc_id long, text string, terms string, length double, item int")
    asked = session.createDataFrame([(i, t, 1, "b") for i, t in items], "item_id long, text string, rank int, doc_id string")
    assert found(named, asked) == plain(docs, items)


def test_bounds_leave_buckets_and_rows_out():
    rng = np.random.default_rng(1)
    weight = np.array([9000, 8000, 50, 40, 30, 20, 10, 5, 3, 2])
    sizes = rng.integers(1, 6, 500)
    rows = [np.sort(rng.choice(10, s, replace=False)) for s in sizes]
    impacts = [rng.integers(1, 10**6, s) for s in sizes]
    length = np.array([math.sqrt((x.astype(float) ** 2 * weight[t]).sum()) for t, x in zip(rows, impacts)])
    none = np.zeros(500, bool)
    bucket = lexical._Bucket(np.arange(500), none, sizes, np.concatenate(rows), np.concatenate(impacts), length, weight)
    query = lexical._Query({t: 1 for t in range(10)}, weight, 10, 0)
    dense = np.zeros(10, np.int64)
    dense[query.terms] = query.weights
    exact = bucket.scores(np.arange(500), dense)
    assert exact.tolist() == [int((weight[t] * x).sum()) for t, x in zip(rows, impacts)]
    for least in np.sort(exact)[[-1, -10, -100, 0]]:
        kept = bucket.survivors(query, least)
        assert set(np.nonzero(exact >= least)[0]) <= set(kept)
    assert len(bucket.survivors(query, np.sort(exact)[-10])) < 60
    assert query.length * length.max() >= exact.max()


def test_query_like_sql(session, small):
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    cursor = duck.execute(queries.statements()["op12_lexical"])
    names = [c[0] for c in cursor.description]
    assert sorted(map(tuple, queries.op12_lexical(session, small).select(*names).collect())) == sorted(cursor.fetchall())
