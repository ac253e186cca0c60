import re
from collections import Counter

import duckdb
import pytest

from parcelwise.llm import collocations, queries

COLUMNS = "lang rank phrase a l r n score".split()


def plain(rows, shortest=2, longest=3, least=2, percent=50, top=50):
    """Phrases by counting everything; rows are (lang, text)."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {}
    often = {key: a for key, a in counts.items() if a >= least and len(key[1]) >= shortest}
    for (lang, phrase), a in often.items():
        inside = [
            n
            for (other, q), n in often.items()
            if other == lang and len(q) > len(phrase) and any(q[i : i + len(phrase)] == phrase for i in range(len(q)))
        ]
        if any(100 * n >= percent * a for n in inside):
            continue
        cuts = []
        for k in range(1, len(phrase)):
            left, right = counts[lang, phrase[:k]], counts[lang, phrase[k:]]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), left, right))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, best in found.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1)
    )


@pytest.fixture
def texts(session):
    def build(*rows):
        return session.createDataFrame(rows, "lang string, text string")

    return build


ROWS = [
    ("en", "New York is big, New York is old. new york"),
    ("en", "of the of the of the of the end; of the end of"),
    ("en", "of the\tmill\nof the mill\x0bof the"),
    ("de", "an der Spree an der Spree"),
    (None, "a b a b a b"),
    ("en", None),
    ("fr", ""),
    ("fr", " . , \n"),
    ("de", "Ääh ääh Ääh ääh"),
    ("xx", "one " * 400),
]


@pytest.mark.parametrize("shard_size", [10**6, 3])
def test_like_counting_everything(texts, shard_size):
    found = collocations.collocations(texts(*ROWS, ROWS[1], ROWS[1]).repartition(3), least=2, top=50, shard_size=shard_size)
    assert sorted(map(tuple, found.select(*COLUMNS).collect())) == plain([*ROWS, ROWS[1], ROWS[1]])


def test_longer_phrases_in_cut_stripes(texts):
    found = collocations.collocations(texts(*ROWS).repartition(4), (2, 5), least=2, top=50, shard_size=2)
    assert sorted(map(tuple, found.select(*COLUMNS).collect())) == plain(ROWS, longest=5)


def test_runs_and_slices_cut_nothing(texts, monkeypatch):
    long = " ".join(f"w{i % 7} w{i % 3}" for i in range(500))
    rows = [("en", long), ("en", long.replace("w1", "w1.")), ("de", long)]
    # A task takes words in runs of this size; the closure carries the values.
    monkeypatch.setattr(collocations, "WORDS_PER_RUN", 64)
    monkeypatch.setattr(collocations, "BYTES_PER_SLICE", 100)
    batches = [collocations.pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})]
    cut = Counter()
    for lang, words, counted in collocations._runs(iter(batches), 2):
        for i in range(counted):
            cut[lang, tuple(words[i : i + 3])] += 1
    whole = Counter()
    for lang, text in rows:
        words = [w for part in collocations._tokens(text) for w in part]
        held = [*words, collocations.BREAK, collocations.BREAK]
        for i in range(len(words)):
            if collocations.BREAK not in held[i : i + 2]:
                whole[lang, tuple(held[i : i + 3])] += 1
    assert {k: n for k, n in cut.items() if collocations.BREAK not in k[1][:2]} == whole


def test_scores_need_more_than_64_bits(session):
    big = 3_000_000_000_000
    counts = session.createDataFrame(
        [("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 1)], "lang string, phrase string, words int, n long"
    )
    found = collocations._cuts(counts.where("words = 2").withColumnRenamed("n", "a"), counts).collect()
    assert [r["score"] for r in found] == [1000000 * (big - 1) ** 2 // big**2]


def test_empty_table_and_clashing_names(session, texts):
    assert collocations.collocations(texts()).count() == 0
    named = session.createDataFrame([("en", "a b a b", "x", 1, 2)], "lang string, text string, phrase string, n int, words int")
    found = collocations.collocations(named, least=2)
    assert found.select("phrase", "a").collect() == [("a b", 2)]


def test_query_like_sql(session):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    cursor = duck.execute(queries.statements()["op11_collocations"])
    names = [c[0] for c in cursor.description]
    found = queries.op11_collocations(session, folder)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(cursor.fetchall())
