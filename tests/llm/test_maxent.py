import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from parcelwise.llm import maxent, queries


def words(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall("[^ \t\n\x0b\x0c\r]+", lowered), "\n"]


def plain(train, texts):
    """(n_tokens, n_known, N, base_score) of each text by counting."""
    counts = Counter(w for text in train for w in words(text))
    total, size = sum(counts.values()), len(counts)
    rows = []
    for text in texts:
        tokens = words(text)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (size + 1))) for w in tokens)
        rows.append((len(tokens), sum(counts[w] > 0 for w in tokens), total, base))
    return rows


def found(df):
    rows = df.orderBy("doc_id", "n_tokens").collect()
    return [(r["n_tokens"], r["n_known"], r["train_tokens"], pytest.approx(r["base_score"])) for r in rows], rows


TEXTS = ["The cat sat on THE mat", None, "", "ÄH äh ah b \t\n\x0bcat", "unheard of words", "the " * 300, "the cat sat on the mat"]


def test_counts_and_base_score(documents):
    train = documents(*enumerate(TEXTS[:4]))
    model = maxent.learned(train)
    assert model.counts.words.count() == model.counts.types
    got, rows = found(maxent.scored(documents(*enumerate(TEXTS)), model))
    assert got == plain(TEXTS[:4], TEXTS)
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in rows)


def test_words_beyond_the_local_ones_meet_their_counts_in_a_join(documents, monkeypatch):
    monkeypatch.setattr(maxent, "LOCAL_WORDS", 3)
    train = [f"word{i % 17} word{i % 5} x" for i in range(60)]
    model = maxent.learned(documents(*enumerate(train)))
    assert len(model.counts.lexicon.number) == 3
    texts = [*train[:9], "word1 never seen word16 never", None]
    got, few = found(maxent.scored(documents(*enumerate(texts)), model))
    assert got == plain(train, texts)
    monkeypatch.undo()
    wide = maxent.Model(maxent.counted(documents(*enumerate(train)).select("text")), model.weights)
    # Three words in classes of their own, the others by hash; in the wide model all stand in classes by rank.
    assert found(maxent.scored(documents(*enumerate(texts)), wide))[0] == got
    assert all(math.isfinite(r["score"]) for r in few)


def test_shares_of_all_types_sum_to_one(documents):
    train = [f"a{i % 3} b{i % 40} c{i % 2000} d" for i in range(2500)]
    model = maxent.learned(documents(*enumerate(train)))
    counts = {r["word"].encode(): r["n"] for r in model.counts.words.collect()}
    assert len(counts) > maxent.HEAD_CLASSES * maxent.WIDTH
    lexicon, types = model.counts.lexicon, [*counts, b"never seen"]
    for before in ([maxent.START, maxent.START], [b"a1", b"b1"], [b"what", b"ever"]):
        run = maxent._Run([[*before, word] for word in types], lexicon)
        network = maxent._Network(model.counts.class_mass, model.counts.word_mass, model.weights)
        known, unknown = network.score(run.hashes, run.klass, run.place, run.at)
        share = 10 ** unknown[-1]
        for i, word in enumerate(types[:-1]):
            klass = run.klass[run.at[i]]
            inside = 1 if klass < maxent.HEAD_CLASSES else (counts[word] + 0.5) / model.counts.class_mass[klass]
            share += 10 ** known[i] * inside
        assert share == pytest.approx(1, abs=1e-3)


def test_learns_what_follows_what(documents):
    rng = np.random.default_rng(5)
    pairs = [("salt", "pepper"), ("bread", "butter"), ("night", "day"), ("left", "right")]
    texts = [" ".join(w for i in rng.integers(0, 4, 40) for w in pairs[i]) for _ in range(300)]
    model = maxent.learned(documents(*enumerate(texts[:250])))
    rows = maxent.scored(documents(*enumerate(texts[250:])), model).collect()
    gain = sum(r["score"] - r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    # Every second word is certain: half of log10(8) is what there is to gain.
    assert gain > 0.35


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    network = maxent._Network(np.ones(maxent.WIDTH), np.ones((maxent.HEAD_CLASSES, maxent.WIDTH)), np.zeros((64, maxent.WIDTH), np.float32))
    network.weights[:] = rng.normal(0, 0.3, network.weights.shape)
    rows, target = [np.array([3]), np.array([9]), np.array([20])], np.array([4])
    before, steps = network.weights.copy(), network.steps.copy()
    network._step(network.class_prior, rows, target, None)
    moved = before - network.weights
    for row in (3, 9, 20):
        slope = np.zeros(maxent.WIDTH)
        for j in range(maxent.WIDTH):
            loss = []
            for change in (1e-2, -1e-2):
                network.weights[:] = before
                network.weights[row, j] += change
                loss.append(-math.log(network.shares(network.class_prior, rows)[0, 4]))
            slope[j] = (loss[0] - loss[1]) / 2e-2
        scale = maxent.RATE / np.sqrt(steps[row] + (slope**2).sum())
        assert moved[row] == pytest.approx(slope * scale, abs=2e-3)


def test_no_training_texts_and_no_rows(documents):
    none = documents().where("false")
    model = maxent.learned(none)
    row = maxent.scored(documents((1, "a b")), model).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)
    assert row["score"] == pytest.approx(0, abs=1e-6) and row["base_score"] == 0
    assert maxent.scored(none, model).count() == 0


def test_long_texts_repeated_rows_and_clashing_names(session, documents, monkeypatch):
    monkeypatch.setattr(maxent, "TOKENS_PER_RUN", 50)
    monkeypatch.setattr(maxent, "BYTES_PER_SLICE", 64)
    long = " ".join(f"w{i % 90} and" for i in range(700))
    model = maxent.learned(documents((0, long), (1, "and w1")))
    lexicon = model.counts.lexicon
    batch = maxent.pa.RecordBatch.from_pydict({"text": [long, None, "x"]})
    tokens = []
    for rows, stretches in maxent._runs(iter([batch]), 0):
        for (_, i), stretch in zip(rows, stretches):
            tokens += [(i, *stretch[k - 2 : k + 1]) for k in range(2, len(stretch))]
    whole = []
    for i, text in enumerate([long, None, "x"]):
        padded = [b"", b"", *(w.encode() for w in words(text))]
        whole += [(i, *padded[k - 2 : k + 1]) for k in range(2, len(padded))]
    assert tokens == whole and lexicon.n.sum() == model.counts.tokens
    named = session.createDataFrame(
        [(7, long, "x", 1), (7, long, "y", 2), (None, "w1", "z", 3)], "doc_id long, text string, words string, _row int"
    )
    rows = maxent.scored(named, model).orderBy("n_tokens").collect()
    assert [r["n_tokens"] for r in rows] == [2, 1401, 1401] and rows[1]["score"] == rows[2]["score"]


def test_query_on_all_documents(session, small):
    rows = queries.op13_maxent(session, small).collect()
    docs = {r["doc_id"]: r["text"] for r in session.read.parquet(f"{small}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    expected = dict(zip(docs, plain([docs[i] for i in docs if not held[i]], docs.values())))
    assert len(rows) == len(docs)
    for r in rows:
        n, known, total, base = expected[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], n, known, total)
        assert r["base_score"] == pytest.approx(base)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_words_of_every_rank_learn_what_they_follow(documents):
    """Words beyond the most frequent ones are told by what stands before them, inside their classes too."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"a{i} b{i}" for i in rng.integers(0, 300, 40)) for _ in range(500)]
    model = maxent.learned(documents(*enumerate(texts[:450])))
    assert model.counts.types > 2 * maxent.HEAD_CLASSES * maxent.WIDTH
    rows = maxent.scored(documents(*enumerate(texts[450:])), model).collect()
    gain = sum(r["score"] - r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    # Half of log10(600) is what there is to gain; telling the class alone gained 0.18.
    assert gain > 0.3


@pytest.mark.parametrize("local", [200_000, 700, 100])
def test_steps_inside_all_classes_share_one(documents, monkeypatch, local):
    monkeypatch.setattr(maxent, "LOCAL_WORDS", local)
    train = [f"a{i % 3} b{i % 40} c{i % 2000} d" for i in range(2500)]
    model = maxent.learned(documents(*enumerate(train)))
    counts = {r["word"].encode(): r["n"] for r in model.counts.words.collect()}
    network = maxent._Network(model.counts.class_mass, model.counts.word_mass, model.weights)
    for before in ([maxent.START, maxent.START], [b"a1", b"b1"]):
        run = maxent._Run([[*before, word] for word in [*counts, b"never seen"]], model.counts.lexicon)
        known, unknown = network.score(run.hashes, run.klass, run.place, run.at)
        klass = run.klass[run.at[:-1]]
        inside = np.where(klass < maxent.HEAD_CLASSES, 1, (np.array([*counts.values()]) + 0.5) / model.counts.class_mass[klass])
        assert (10 ** known[:-1] * inside).sum() + 10 ** unknown[-1] == pytest.approx(1, abs=1e-3)
        # Each frequent word of the classes by rank has a leaf of its own.
        whose, node, output = network.inside(run.klass[run.at], run.place[run.at])
        ends = {i: (n, o) for i, n, o in zip(whose.tolist(), node.tolist(), output.tolist())}
        ranked = np.flatnonzero(klass < maxent.REST).tolist()
        assert len(ranked) == min(local, len(counts)) == len({ends[i] for i in ranked})


def test_rows_of_equal_keys_are_summed():
    rng = np.random.default_rng(1)
    keys, values = rng.integers(0, 40, 500).astype(np.uint16), rng.normal(size=(500, maxent.WIDTH)).astype(np.float32)
    for some in (slice(None), slice(0, 1)):
        row, total = maxent._summed(values[some], keys[some])
        assert row.tolist() == sorted(set(keys[some].tolist()))
        for key, found in zip(row, total):
            assert found == pytest.approx(values[some][keys[some] == key].sum(0), abs=1e-5)
