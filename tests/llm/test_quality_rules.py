import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from parcelwise.llm import quality_rules as q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(covered),
    )


@pytest.mark.parametrize(
    "text",
    [None, "", "a", "a b", "a b c a b c", "a a a a", "x\n\n x\nx\n\t\nx\r", "é🙂 #| <b> ü", "a b c\x1cd", "one two three four one two three"],
)
def test_measures(text):
    assert q.measures(text) == plain_measures(text)


def test_measures_of_random_texts():
    rnd = random.Random(4)
    for _ in range(200):
        text = "".join(rnd.choice(["a", "b", "é", " ", "  ", "\n", "#", "|"]) for _ in range(rnd.randint(0, 80)))
        assert q.measures(text) == plain_measures(text)


def exact_cdf(x, n, p):
    p = Fraction(p)
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1)))


@pytest.mark.parametrize("n", [1, 7, 150, 900])
@pytest.mark.parametrize("p", [0.01, 0.25, 0.5])
def test_binomial(n, p):
    for x in {0, 1, n // 10, n // 3, n - 1, n}:
        if x >= 0:
            assert q.binomial_cdf(x, n, p) == pytest.approx(exact_cdf(x, n, p), rel=1e-9, abs=1e-12)
    assert q.binomial_cdf(-1, n, p) == 0


def plain_cutoffs(good, false_rejection, level):
    """Cutoffs per (stratum, rule) by testing rung after rung."""
    strata, found = {g["stratum"] for g in good}, {}
    for s in strata:
        own = [g for g in good if g["stratum"] == s]
        for rule in q.RULES:
            found[s, rule.name] = None
            for cut in rule.cutoffs:
                rejected = sum(eval(rule.value, {}, g) > cut for g in own)
                safe = exact_cdf(rejected, len(own), false_rejection / len(q.RULES)) <= level / (len(strata) * len(q.RULES))
                if not safe:
                    break
                found[s, rule.name] = cut
    return found


def test_cutoffs_and_verdict(session):
    rnd = random.Random(8)
    rows = []
    for i in range(900):
        words = [f"w{rnd.randint(0, 500)}" + "#" * (rnd.random() < (0.02 if i % 30 else 0.9)) for _ in range(60)]
        rows.append((i, " ".join(words), ["en", "de", None][i % 3] if i % 41 else "rare", f"s{i % 2}", 1))
    rows += [(1000 + i, "short", "en", "s", 1) for i in range(3)]
    rows += [(2000 + i, " ".join(["same words here"] * 40), "de", "s", 1) for i in range(3)]
    docs = session.createDataFrame(rows, "doc_id long, text string, lang string, kept string, n_words int")
    labels = session.createDataFrame([(r[0], int(r[0] % 10 > 0)) for r in rows] + [(5, 0), (None, 1), (77777, 1)], "doc_id long, quality int")
    found = q.judged(docs, labels, false_rejection=0.2, level=0.2).collect()
    assert len(found) == len(rows)
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    table = {r[0]: dict(zip(names, plain_measures(r[1]), strict=True)) | {"stratum": r[2] or ""} for r in rows}
    failed = {i: m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"] for i, m in table.items()}
    good = [m for i, m in table.items() if i % 10 and i != 5 and not failed[i]]
    cuts = plain_cutoffs(good, 0.2, 0.2)
    assert any(c is not None for c in cuts.values()) and any(c is None for c in cuts.values())
    for r in found:
        m, v = table[r["doc_id"]], r["_quality"]
        assert tuple(v[n] for n in names) == tuple(m[n] for n in names)
        passes = all(
            cuts.get((m["stratum"], x.name)) is None or eval(x.value, {}, m) <= cuts[m["stratum"], x.name]
            for x in q.RULES
            if m["n_words"] and m["n_lines"]
        )
        assert (v["base_failed"], v["kept"]) == (failed[r["doc_id"]], not failed[r["doc_id"]] and passes)


def test_edge_cases(documents, session):
    text = " ".join(f"word{i}" for i in range(60))
    docs = documents((None, text), (1, None), (2, ""), (3, text), (3, text), (3, "short")).withColumn("hits", F.lit(1))
    none = session.createDataFrame([], "doc_id long, quality int")
    found = q.judged(docs, none)
    assert sorted((str(r["doc_id"]), r["_quality"]["kept"]) for r in found.collect()) == sorted(
        [("None", True), ("1", False), ("2", False), ("3", True), ("3", True), ("3", False)]
    )
    kept = q.accepted(docs, none)
    assert kept.columns == docs.columns and kept.count() == 3
    assert q.judged(docs.limit(0), none).count() == 0
