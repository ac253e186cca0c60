"""Toxicity by a weighted finite-state pattern grammar.

Five machines read the words of a clause as classes and are composed to one:

- the lexicon, a letter trie of stems, rewrites a word to the class insult, threat, target, negation, report or other;
- reported speech marks what follows a verb of saying in its clause;
- negation marks the few words that follow a negation;
- insult and threat machines turn their words into events and keep the marks;
- the target machine adds whether the clause addresses somebody, before or after.

A clause thus yields events such as "insult, addressed" or "threat, negated, reported". Each event kind has a weight, each stem
has one, and a text's score is the logistic function of its weighted events; a word counts through its clause only.

Stems of insults are learned from labelled texts: all labelled rows are counted, and word beginnings that toxic texts
hold far more often than others become stems. Event weights are fitted to a bounded sample of labelled rows, starting from
prior weights, which remain for events the labels do not show. Closed word classes are fixed lists.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.shared import arrow_map, probably_in
from parcelwise.session import materialised

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "other", "insult", "threat", "target", "negation", "report"

# Closed word classes of the four languages, in plain lists.
TARGETS = "you your yours yourself he she they them him her people everyone this these du dich dir ihr euch sie diese er tu toi te vous ton votre il elle ils ce cette usted ustedes tú ti vosotros él ella ellos este esta".split()
NEGATIONS = "not no never nobody nothing isn't aren't wasn't don't doesn't didn't won't nicht kein keine keinen nie niemals ne pas jamais aucun aucune nunca jamás tampoco ningún ninguna".split()
REPORTS = "said says wrote writes told tells asked claimed claims quoted quotes called calls sagte sagt schrieb schreibt behauptet behauptete dit disait écrit écrivait raconte affirme dijo dice escribió escribe afirma afirmó".split()
THREATS = "kill kills murder hurt destroy burn shoot stab strangle töten umbringen verletzen zerstören verbrennen tuer tuerai détruire brûler frapper matar mataré destruir quemar golpear".split()
INSULTS = "idiot idiots moron morons scum worthless pathetic stupid loser losers".split()

# Words after a negation that it covers.
NEGATION_REACH = 3
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
CLAUSE = re.compile(r"[.!?;:\n]+")
# Letters of a word a stem can have, the lengths tried, and how many stems the lexicon may have.
LONGEST = 24
SHORTEST_STEM = 4
LONGEST_STEM = 14
STEMS = 4000
# Evidence a stem needs: log-likelihood ratio, and odds of toxic to other texts.
EVIDENCE = 30.0
LEAST_LOG_ODDS = 1.5
SAMPLE = 8000
# Words a task remembers the class of.
REMEMBERED = 300_000


class Lexicon:
    """A letter trie as a transducer: reads a word, returns its class and weight. Entries are stems or whole words."""

    def __init__(self, stems: Iterable[tuple[str, str, float]], whole: Iterable[tuple[str, str, float]]) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.stem: dict[int, tuple[str, float]] = {}
        self.final: dict[int, tuple[str, float]] = {}
        for entries, ends in ((stems, self.stem), (whole, self.final)):
            for text, kind, weight in entries:
                state = 0
                for letter in text:
                    if letter not in self.arcs[state]:
                        self.arcs[state][letter] = len(self.arcs)
                        self.arcs.append({})
                    state = self.arcs[state][letter]
                ends.setdefault(state, (kind, weight))
        self.known: dict[str, tuple[str, float] | None] = {}

    def __call__(self, word: str) -> tuple[str, float] | None:
        """Class and weight of a lower-case word; nothing for the class other. The longest match wins."""
        if word in self.known:
            return self.known[word]
        state, found = 0, None
        for letter in word:
            state = self.arcs[state].get(letter, -1)
            if state < 0:
                break
            found = self.stem.get(state, found)
        else:
            found = self.final.get(state, found)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = found
        return found


@dataclass(frozen=True)
class Symbol:
    """What the machines pass on: a word class and its marks."""

    kind: str
    negated: bool = False
    reported: bool = False
    addressed: bool = False


@dataclass
class Machine:
    """A deterministic transducer: ``step`` gives the next state and the rewritten symbol."""

    start: int
    step: Callable[[int, Symbol], tuple[int, Symbol]]


def reported_speech() -> Machine:
    """State 1 after a verb of saying: what follows is reported."""

    def step(state: int, s: Symbol) -> tuple[int, Symbol]:
        if s.kind == REPORT:
            return 1, s
        return state, Symbol(s.kind, s.negated, state == 1, s.addressed)

    return Machine(0, step)


def negation() -> Machine:
    """The state counts down the words a negation still covers."""

    def step(state: int, s: Symbol) -> tuple[int, Symbol]:
        if s.kind == NEGATION:
            return NEGATION_REACH, s
        return max(0, state - 1), Symbol(s.kind, state > 0, s.reported, s.addressed)

    return Machine(0, step)


def target() -> Machine:
    """State 1 after somebody was addressed; the mark holds for the rest of the clause."""

    def step(state: int, s: Symbol) -> tuple[int, Symbol]:
        if s.kind == TARGET:
            return 1, s
        return state, Symbol(s.kind, s.negated, s.reported, state == 1)

    return Machine(0, step)


def only(*kinds: str) -> Machine:
    """Insult and threat machine: passes its own words and drops what no later machine needs."""

    def step(state: int, s: Symbol) -> tuple[int, Symbol]:
        return state, s if s.kind in kinds else Symbol(OTHER)

    return Machine(0, step)


def composed(*machines: Machine) -> tuple[dict, dict]:
    """One machine that does what the given ones do in turn: its arcs by (state, class), with state 0 as start.

    States are the tuples of the machines' states that can be reached, numbered.
    """
    start = tuple(m.start for m in machines)
    number, arcs, outputs, open_ = {start: 0}, {}, {}, [start]
    while open_:
        state = open_.pop()
        for kind in (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT):
            symbol, following = Symbol(kind), []
            for machine, own in zip(machines, state, strict=True):
                own, symbol = machine.step(own, symbol)
                following.append(own)
            after = tuple(following)
            if after not in number:
                number[after] = len(number)
                open_.append(after)
            arcs[number[state], kind] = number[after]
            outputs[number[state], kind] = symbol
    return arcs, outputs


GRAMMAR = (reported_speech, negation, target)


def event_names() -> list[str]:
    """The kinds of events in a fixed order."""
    return [
        "_".join([kind, *(m for m, on in zip(("addressed", "negated", "reported"), marks, strict=True) if on)])
        for kind in (INSULT, THREAT)
        for marks in [(a, n, r) for a in (0, 1) for n in (0, 1) for r in (0, 1)]
    ]


EVENTS = event_names()
# Prior weight of an event: full for a plain or addressed one, a part if it is negated or reported.
PRIOR = {
    name: (1.2 if INSULT in name else 1.4)
    * (1.1 if "addressed" in name else 1.0)
    * (0.35 if "negated" in name else 1.0)
    * (0.45 if "reported" in name else 1.0)
    for name in EVENTS
}
PRIOR_CONSTANT = -3.0


class Grammar:
    """The lexicon composed with the clause machines."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.arcs, self.outputs = composed(*(m() for m in GRAMMAR), only(INSULT, THREAT))

    def clause(self, classes: list[tuple[str, float] | None]) -> Iterator[tuple[int, float]]:
        """(event number, weight of the word) for each event of a clause."""
        state, found = 0, []
        addressed = any(c is not None and c[0] == TARGET for c in classes)
        for c in classes:
            kind = c[0] if c else OTHER
            symbol, state = self.outputs[state, kind], self.arcs[state, kind]
            if symbol.kind != OTHER:
                # An address that follows counts as well: the clause has been read to its end here.
                found.append((symbol, c[1]))
        for symbol, weight in found:
            marks = (("addressed", symbol.addressed or addressed), ("negated", symbol.negated), ("reported", symbol.reported))
            yield EVENT_NUMBER["_".join([symbol.kind, *(m for m, on in marks if on)])], weight

    def features(self, text: str | None) -> np.ndarray:
        """Per event kind the largest word weight, and the logarithm of one plus the sum of the others."""
        best, total = np.zeros(len(EVENTS)), np.zeros(len(EVENTS))
        for clause in CLAUSE.split((text or "").lower()):
            classes = list(map(self.lexicon, WORD.findall(clause)))
            if any(c is not None and c[0] in (INSULT, THREAT) for c in classes):
                for event, weight in self.clause(classes):
                    best[event] = max(best[event], weight)
                    total[event] += weight
        return np.concatenate([best, np.log1p(total - best)])


EVENT_NUMBER = {name: i for i, name in enumerate(EVENTS)}


@dataclass
class Model:
    """Lexicon entries and fitted weights."""

    stems: list[tuple[str, str, float]] = field(default_factory=list)
    whole: list[tuple[str, str, float]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: prior())

    def grammar(self) -> Grammar:
        fixed = [(TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT), (INSULTS, INSULT)]
        words = [*self.whole, *((w, kind, 1.0) for listed, kind in fixed for w in listed)]
        return Grammar(Lexicon(self.stems, words))


def prior() -> np.ndarray:
    """Weights before any label was seen: events, repeated events, constant."""
    events = np.array([PRIOR[n] for n in EVENTS])
    return np.concatenate([3 * events, 0.5 * events, [PRIOR_CONSTANT]])


def score(model_weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ model_weights[:-1] + model_weights[-1], -30, 30)))


def fit(features: np.ndarray, target: np.ndarray, pull: float = 2.0, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps, pulled towards the prior weights; event weights never turn negative."""
    start = prior()
    weights, x = start.copy(), np.hstack([features, np.ones((len(features), 1))])
    strength = np.r_[np.full(len(start) - 1, pull), 1e-3]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - target) + strength * (weights - start)
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(strength)
        step = np.linalg.solve(bend, slope)
        step *= min(1.0, 3.0 / (np.abs(step).max() + 1e-12))
        weights -= step
        weights[:-1] = np.maximum(weights[:-1], 0)
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _beginnings(word: str) -> Iterator[str]:
    """The stems a word could have; a whole word is its own stem with an end mark."""
    for size in range(SHORTEST_STEM, min(len(word), LONGEST_STEM) + 1):
        yield word[:size]
    if len(word) <= LONGEST:
        yield word + "$"


def evidence(toxic: int, other: int, all_toxic: int, all_other: int) -> tuple[float, float]:
    """Log-likelihood ratio of a stem's counts against chance, and its smoothed log odds."""
    n, share = toxic + other, all_toxic / (all_toxic + all_other)
    ratio = sum(2 * c * math.log(c / (n * s)) for c, s in ((toxic, share), (other, 1 - share)) if c)
    odds = math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((other + 0.5) / (all_other + 1))
    return ratio, odds


def learned_stems(labelled: DataFrame, limit: int = STEMS) -> list[tuple[str, str, float]]:
    """At most ``limit`` stems of insults with weights, from all rows of ``labelled`` (``text``, ``label``).

    Every text counts once per word. A stem is kept if no shorter one of its beginnings is; stems that only one word has are kept as whole words.
    """
    def words(batches: Iterator[dict]) -> Iterator[dict]:
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                for word in set(WORD.findall((text or "").lower())):
                    if len(word) <= 4 * LONGEST:
                        counts[word][label == 1] += 1
                counts[""][label == 1] += 1
            if len(counts) > 200_000:
                yield {"word": list(counts), "other": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]}
                counts.clear()
        yield {"word": list(counts), "other": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]}

    def stems(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {"stem": [], "word": [], "other": [], "toxic": []}
            for word, other, toxic in zip(batch["word"], batch["other"], batch["toxic"], strict=True):
                for stem in _beginnings(word) if word else [""]:
                    for name, value in zip(out, (stem, zlib.crc32(word.encode()), other, toxic), strict=True):
                        out[name].append(value)
            yield out

    counted = arrow_map(labelled.select("text", "label"), "word string, other long, toxic long", words)
    counted = counted.groupBy("word").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    by_stem = (
        arrow_map(counted, "stem string, word long, other long, toxic long", stems)
        .groupBy("stem")
        .agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"), F.min("word").alias("low"), F.max("word").alias("high"))
    )
    by_stem = materialised(by_stem.where("toxic > other or stem = ''"))
    total = by_stem.where("stem = ''").first()
    if total is None or not total["toxic"] or not total["other"]:
        return []
    sums = (total["toxic"], total["other"])

    def judged(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            found = [evidence(t, o, *sums) for t, o in zip(batch["toxic"], batch["other"], strict=True)]
            yield batch | {"ratio": [f[0] for f in found], "odds": [f[1] for f in found]}

    layout = "stem string, other long, toxic long, low long, high long, ratio double, odds double"
    good = arrow_map(by_stem.where("stem <> ''"), layout, judged).where(
        f"ratio >= {EVIDENCE} and odds >= {LEAST_LOG_ODDS} and (low <> high or endswith(stem, '$'))"
    )
    # The strongest stems, a fixed number of them.
    rows = good.orderBy(F.desc("ratio"), "stem").limit(limit).collect()
    found: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r["stem"].rstrip("$")), r["stem"])):
        bare = r["stem"].rstrip("$")
        if not any(bare[:n] in found for n in range(SHORTEST_STEM, len(bare) + 1)):
            found[r["stem"]] = r["odds"]
    top = max(found.values(), default=1.0)
    return [(s, INSULT, w / top) for s, w in found.items()]


def one_vote_each(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(``text``, ``label``) of the labelled documents, each text once however many copies it has.

    Which document stands for a text is settled on hashes; texts move only of documents that are probably chosen.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    hashed = texts.select("doc_id", F.xxhash64("text").alias("_h"))
    chosen = hashed.join(labels, "doc_id").groupBy("_h").agg(
        F.max("label").alias("label"), F.min("doc_id").alias("doc_id")
    )
    chosen = materialised(chosen.withColumn("_key", F.xxhash64("doc_id", "_h")))
    keyed = texts.withColumn("_key", F.xxhash64("doc_id", F.xxhash64("text")))
    near = probably_in(keyed, "_key", chosen).select("_key", "text")
    return near.join(chosen.select("_key", "label"), "_key").dropDuplicates(["_key"]).select("text", "label")


def learned(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """A model from the labels (``doc_id``, ``label``) for which ``learn`` holds.

    Stems come from all of these rows, event weights from at most ``sample`` rows per class.
    """
    clean = (
        labels.where(learn)
        .where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("label").cast("int").alias("label"))
    )
    found = learned_stems(one_vote_each(docs, clean))
    ends, open_ = [s for s in found if s[0].endswith("$")], [s for s in found if not s[0].endswith("$")]
    model = Model(open_, [(s[:-1], kind, w) for s, kind, w in ends])
    drawn = None
    for label in (0, 1):
        own = clean.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        drawn = own if drawn is None else drawn.unionByName(own)
    # At most two times `sample` rows.
    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(drawn), "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        grammar = sent.value.grammar()
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "label": batch["label"], "x": [grammar.features(t) for t in batch["text"]]}

    seen = sorted(arrow_map(chosen, "doc_id long, label int, x array<double>", rows).collect())
    if {r["label"] for r in seen} == {0, 1}:
        model.weights = fit(np.array([r["x"] for r in seen]), np.array([r["label"] for r in seen], float))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``score`` and ``events`` (number of clause events by kind with any weight).

    Only the text enters a score. A null text counts as empty and scores what a text without events scores. Null and
    repeated ids keep their rows; other columns are ignored; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        grammar, weights = sent.value.grammar(), sent.value.weights
        for batch in batches:
            x = np.array([grammar.features(t) for t in batch["text"]]).reshape(-1, 2 * len(EVENTS))
            named = [[n for n, v in zip(EVENTS, row, strict=False) if v > 0] for row in x]
            yield {"doc_id": batch["doc_id"], "score": score(weights, x), "events": named}

    return arrow_map(
        docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, score double, events array<string>", rows
    )
