import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.llm import quality_net, toxicity
from parcelwise.llm.queries import op7_toxicity, op10_quality_net

FOLDER = "/root/testdata/sf0.01"


def held_out(session, query, column, spread):
    labels = session.read.parquet(f"{FOLDER}/labels.parquet")
    rows = query(session, FOLDER).cache()
    docs = session.read.parquet(f"{FOLDER}/documents.parquet")
    assert rows.count() == docs.count()
    assert rows.where("score < 0 or score > 1 or score is null").count() == 0
    seen = rows.where("held_out").join(labels, "doc_id").collect()
    return sum(r["predicted"] == r[column] for r in seen) / len(seen)


def test_toxicity_of_held_out_texts(session):
    assert held_out(session, op7_toxicity, "toxic", 5) >= 0.97


def test_quality_of_held_out_texts(session):
    assert held_out(session, op10_quality_net, "quality", 4) >= 0.95


def test_gradients():
    rnd = np.random.default_rng(1)
    network = quality_net.Network.initial(3)
    for name in ("bytes", "filters", "offsets", "output"):
        setattr(network, name, getattr(network, name).astype(np.float64) + 0.01 * rnd.standard_normal(getattr(network, name).shape))
    texts = [quality_net.chunks("".join(map(chr, rnd.integers(97, 122, n)))) for n in (10, 400, 900)]
    rows, starts = np.concatenate(texts), np.cumsum([0, *map(len, texts)])[:-1]
    target = np.array([1.0, 0.0, 1.0])
    slopes, _ = network.gradients(rows, starts, target)
    for name in ("bytes", "filters", "offsets", "output"):
        value = getattr(network, name)
        for at in zip(*(rnd.integers(0, n, 6) for n in value.shape), strict=True):
            kept, losses = value[at], []
            for change in (1e-6, -1e-6):
                value[at] = kept + change
                losses.append(network.gradients(rows, starts, target)[1])
            value[at] = kept
            assert getattr(slopes, name)[at] == pytest.approx((losses[0] - losses[1]) / 2e-6, rel=1e-3, abs=1e-6)


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 480, 481, 5000])
def test_chunks_cover_the_text(size):
    text = "".join(chr(33 + i % 90) for i in range(size))
    found = quality_net.chunks(text)
    stride = quality_net.STRIDE
    joined = b"".join(c[:stride].tobytes() for c in found[:-1]) + found[-1].tobytes()
    assert joined.rstrip(b" ") == text.encode() and len(found) == max(1, -(-(size - 256) // stride) + 1)


def test_scores_do_not_depend_on_the_batch():
    network = quality_net.Network.initial(2)
    texts = ["", None, "a" * 9000, "short", "x y z " * 400, "É" * 70_000]
    alone = [network.scores([t])[0] for t in texts]
    assert network.scores(texts) == pytest.approx(alone, abs=1e-6) and network.scores([]) == []
    columns = network.columns(quality_net.chunks(texts[2]))
    plain = np.maximum((columns @ network.filters).reshape(-1, 252, quality_net.FILTERS).max(1) + network.offsets, 0)
    assert np.allclose(network.pooled(quality_net.chunks(texts[2])), plain, atol=1e-5)


def edge_docs(documents):
    return documents((None, "some text"), (1, None), (2, ""), (2, "you idiot"), (3, "w " * 50_000)).withColumn("score", F.lit("own"))


def test_quality_edge_cases(documents, session):
    labels = session.createDataFrame([(1, 1), (2, None), (3, 7)], "doc_id long, label int")
    found = quality_net.scored(edge_docs(documents), labels, F.lit(True)).collect()
    assert [r["score"] for r in found] == [1.0] * 5
    found = quality_net.scored(edge_docs(documents), labels.limit(0), F.lit(True)).collect()
    assert [r["score"] for r in found] == [0.5] * 5
    assert quality_net.scored(edge_docs(documents).limit(0), labels, F.lit(True)).count() == 0


def grammar():
    return toxicity.Model().grammar()


def events(text):
    x = grammar().features(text)
    return {n for n, v in zip(toxicity.EVENTS, x, strict=False) if v > 0}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("The idiot fell.", {"insult"}),
        ("You are an idiot.", {"insult_addressed"}),
        ("An idiot, you!", {"insult_addressed"}),
        ("You are not an idiot.", {"insult_addressed_negated"}),
        ("Not one thing that the old idiot saw.", {"insult"}),
        ("She said you are an idiot.", {"insult_addressed_reported"}),
        ("He said so. Idiot!", {"insult"}),
        ("I will kill you", {"threat_addressed"}),
        ("never kill anything", {"threat_negated"}),
        ("nothing of that sort", set()),
        ("", set()),
    ],
)
def test_clauses(text, expected):
    assert events(text) == expected


def test_composed_machine_is_the_machines_in_turn():
    arcs, outputs = toxicity.composed(toxicity.reported_speech(), toxicity.negation())
    kinds = [toxicity.OTHER, toxicity.INSULT, toxicity.NEGATION, toxicity.REPORT]
    rnd = np.random.default_rng(2)
    for _ in range(50):
        state, own = 0, [0, 0]
        machines = [toxicity.reported_speech(), toxicity.negation()]
        for kind in rnd.choice(kinds, 12):
            symbol = toxicity.Symbol(str(kind))
            for i, machine in enumerate(machines):
                own[i], symbol = machine.step(own[i], symbol)
            assert outputs[state, str(kind)] == symbol
            state = arcs[state, str(kind)]


def test_stems_are_learned(documents, session):
    toxic = [(i, f"text{i} has grumblo{'abcdefghij'[i % 10]} in place{i}. And vile{i % 3} too") for i in range(60)]
    clean = [(100 + i, f"text{i} has grumpy in place{i}. And vila{i % 3} too") for i in range(90)]
    copies = [(300 + i, "a copied text with onlyhere inside") for i in range(50)]
    rows = [(*r, 1) for r in toxic + copies] + [(*r, 0) for r in clean]
    labels = session.createDataFrame([(r[0], r[2]) for r in rows] + [(9999, 1)], "doc_id long, label int")
    votes = toxicity.one_vote_each(documents(*[r[:2] for r in rows], (None, "x"), (7000, "unlabelled")), labels)
    assert votes.count() == 60 + 90 + 1
    found = toxicity.learned_stems(votes)
    stems = {s for s, _, _ in found}
    assert any("grumblo".startswith(s) and len(s) > 4 for s in stems) and "vile" in stems
    assert not any("onlyhere".startswith(s.rstrip("$")) or "grumpy".startswith(s.rstrip("$")) for s in stems)


def test_toxicity_edge_cases(documents, session):
    labels = session.createDataFrame([(1, 1), (2, None), (3, 7)], "doc_id long, label int")
    for given in (labels, labels.limit(0)):
        model = toxicity.learned(edge_docs(documents), given, F.lit(True))
        found = toxicity.scored(edge_docs(documents), model).collect()
        assert [r["score"] >= 0.5 for r in found] == [False, False, False, True, False]
    assert toxicity.scored(edge_docs(documents).limit(0), model).count() == 0
