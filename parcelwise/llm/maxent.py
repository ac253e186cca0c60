"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

A token is predicted in steps, its class and the word within the class, from the word before, the two words before,
and the one before the last alone (a skip). Frequent words stand in classes by rank, of 16 words first and of up to 65,536 later,
and each has an output of its own, one to four steps down the tree of its class. The words beyond them share a class whose tree goes
by hash to 65,536 leaves; in a leaf counts divide what its words have. Unknown words are one type with a class of its own. Each
step is a softmax over 16 outputs whose logits are the log of the counted shares plus the weight rows of the three features, which
hashing finds in one table of fixed size. Without weights the model is the plain word distribution.

Counts cover every training text and grow with them. Weights are learned in rounds, each over a part of the training texts
of its own: learners take steps of gradient descent from the common table, and their changes are averaged row by row in a
shuffle. The table has a fixed size, so has what the driver holds; the words beyond the most frequent ones meet their
counts in a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parcelwise.llm.shared import prepared
from parcelwise.session import materialised

# Outputs of a softmax: classes, and words of a class.
WIDTH = 16
HEAD_CLASSES = 10
TAIL_CLASSES = WIDTH - HEAD_CLASSES - 1
UNKNOWN = WIDTH - 1

# Steps inside the classes; a class has WIDTH**steps leaves. Words are dealt to the leaves by rank, but for the last class, where
# all the others stand by hash.
STEPS = np.array([1] * HEAD_CLASSES + [2, 3, 4, 4, 4])
LEAVES = WIDTH**STEPS
REST = len(STEPS) - 1
RANKED = int(LEAVES[:REST].sum())
FIRST_LEAF = np.cumsum(LEAVES) - LEAVES
# A tree has one node, then 16 times as many each step.
NODES = (LEAVES - 1) // (WIDTH - 1)
FIRST_NODE = np.cumsum(NODES) - NODES

# Most frequent words whose counts every task knows; all others meet theirs in a join.
LOCAL_WORDS = 200_000

# Rows of the weight table (a power of two), and of a part of it that is shuffled as one row.
ROWS = 1 << 16
ROWS_PER_PART = 1 << 12

ROUNDS = 3
RATE = 0.25
TOKENS_PER_STEP = 4_096

# Text a learner is given in a round, so that tables sent around stay small against the texts.
LEARNER_BYTES = 16 << 20

TOKENS_PER_RUN = 100_000
WORDS_PER_COUNT = 1_000_000
BYTES_PER_SLICE = 1 << 20

# The end of a text is a token like words; no word looks like it, and none is empty, as the place before a text is.
END = b"\n"
START = b""
_BLANKS = b" \t\n\x0b\x0c\r"


def _slices(text: str | None) -> Iterator[list[bytes]]:
    """Words of a whole text with A-Z lower-cased, in slices; the last one closes with the end."""
    raw = (text or "").encode().lower()
    start = 0
    while len(raw) - start > BYTES_PER_SLICE:
        end = start + BYTES_PER_SLICE
        while end < len(raw) and raw[end] not in _BLANKS:
            end += 1
        yield raw[start:end].split()
        start = end
    yield [*raw[start:].split(), END]


def _count(texts: DataFrame) -> DataFrame:
    """``word`` (the end included) and ``n`` over all ``texts`` (``text``)."""
    schema = StructType.fromDDL("word string, n long")
    arrow = to_arrow_schema(schema)

    def out(counts: Counter) -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        size = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words in _slices(text):
                    counts.update(words)
                    size += len(words)
                    if size >= WORDS_PER_COUNT:
                        yield out(counts)
                        counts, size = Counter(), 0
        yield out(counts)

    return texts.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (the finaliser of splitmix64, fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lexicon:
    """The frequent words by number, most frequent first, with what tasks look up for them; of bounded size."""

    def __init__(self, words: list[bytes], n: np.ndarray):
        self.number = {word: i for i, word in enumerate(words)}
        self.n = n
        self.klass, self.place, self.hashes = self.of(words)
        rank = np.arange(min(len(words), RANKED))
        klass = np.searchsorted(FIRST_LEAF, rank, "right") - 1
        self.klass[: len(rank)], self.place[: len(rank)] = klass, rank - FIRST_LEAF[klass]

    @staticmethod
    def of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes, leaves and hashes of words without a rank."""
        crc = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        length = np.fromiter(map(len, words), np.uint64, len(words))
        return np.full(len(words), REST), (crc % np.uint64(LEAVES[REST])).astype(np.int64), _mixed(crc + (length << np.uint64(32)))


@dataclass(frozen=True)
class Counts:
    """What all training texts give: totals, frequent words, and the shares that the classes start from."""

    words: DataFrame  # word, n: every training word
    tokens: int
    types: int
    lexicon: Lexicon
    class_mass: np.ndarray  # per class
    word_mass: np.ndarray  # per node of the classes and output


def counted(texts: DataFrame) -> Counts:
    """Counts over ``texts`` (``text``). Mass for unknown words is the number of words seen once (Good-Turing)."""
    words = materialised(_count(texts))
    tokens, types, once = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1)
    ).first()
    frequent = words.orderBy(F.desc("n"), "word").limit(LOCAL_WORDS).toArrow()
    lexicon = Lexicon(
        [word.encode() for word in frequent.column("word").to_pylist()], frequent.column("n").to_numpy().astype(np.int64)
    )
    # At most one row per leaf of the rest comes back; ranked words have leaves of their own.
    leaf = (F.crc32(F.col("word").cast("binary")) % int(LEAVES[REST])).alias("leaf")
    found = words.groupBy(leaf).agg(F.sum(F.col("n") + 0.5).alias("mass")).toArrow()
    rest, ranked = np.zeros(LEAVES[REST]), lexicon.n[:RANKED] + 0.5
    rest[found.column("leaf").to_numpy()] = found.column("mass").to_numpy()
    np.subtract.at(rest, Lexicon.of(list(lexicon.number)[: len(ranked)])[1], ranked)
    masses = np.concatenate([ranked, np.zeros(RANKED - len(ranked)), np.maximum(rest, 0)])
    of_class = np.split(masses, FIRST_LEAF[1:])
    class_mass = np.array([*map(np.sum, of_class), max(once, 0.5)])
    nodes = [mass.reshape(WIDTH**i, WIDTH, -1).sum(2) for mass, steps in zip(of_class, STEPS) for i in range(steps)]
    return Counts(words, tokens, types, lexicon, class_mass, np.concatenate(nodes))


ONES = np.ones(WIDTH, np.float32)


def _log(mass: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(mass, 1e-30)).astype(np.float32)


def _shares(logs: np.ndarray) -> np.ndarray:
    """Shares of 1 in each row, from the logs of masses."""
    masses = np.exp(logs)
    return masses / masses.sum(-1, keepdims=True)


def _picked(rows: np.ndarray, output: np.ndarray) -> np.ndarray:
    """One output of each row."""
    return np.take(rows, np.arange(0, rows.size, WIDTH) + output)


def _summed(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, and the sum of the rows of each; most keys have one row, which is only copied."""
    order = np.argsort(keys, kind="stable")
    in_order = np.take(keys, order)
    new = np.ones(len(keys), bool)
    np.not_equal(in_order[1:], in_order[:-1], out=new[1:])
    starts, more = np.flatnonzero(new), np.flatnonzero(~new)
    total = np.take(values, order[starts], axis=0)
    if len(more):
        which = np.cumsum(new)[more] - 1
        first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        # Two numbers are added at once as a complex one.
        sums = np.add.reduceat(np.take(values, order[more], axis=0).view(np.complex64), first, axis=0)
        total[which[first]] += sums.view(np.float32)
    return in_order[starts].astype(np.intp), total


class _Network:
    """The table of weights with the shares it corrects; numpy, in one task."""

    def __init__(self, class_mass: np.ndarray, word_mass: np.ndarray, weights: np.ndarray):
        self.class_prior, self.word_prior = _log(class_mass), _log(word_mass)
        self.class_shares, self.word_shares = _shares(self.class_prior), _shares(self.word_prior)
        self.weights = weights
        self.mask = np.uint64(len(weights) - 1)
        # Short numbers sort in linear time.
        self.kind = np.uint16 if len(weights) <= 1 << 16 else np.int64
        self.steps = np.ones(len(weights), np.float32)
        self.salt = _mixed(np.arange(1, len(word_mass) + 1, dtype=np.uint64))

    @staticmethod
    def inside(klass: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The steps inside the classes of words: whose step it is, from which node, to which output."""
        steps, first = np.take(STEPS, klass), np.take(FIRST_NODE, klass)
        whose, node, output = [], [], []
        for i in range(STEPS.max()):
            on = np.flatnonzero(steps > i)
            below = place[on] >> (4 * (steps[on] - 1 - i))
            whose.append(on)
            node.append(first[on] + (WIDTH**i - 1) // (WIDTH - 1) + (below >> 4))
            output.append(below & (WIDTH - 1))
        return np.concatenate(whose), np.concatenate(node), np.concatenate(output)

    def features(self, hashes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Hashes of the three contexts of the tokens at ``at``, which have two predecessors each."""
        last, before = hashes[at - 1], hashes[at - 2]
        both = _mixed(last * np.uint64(3) + np.uint64(1)) ^ before
        return [_mixed(last * np.uint64(4) + np.uint64(1)), _mixed(both), _mixed(before * np.uint64(4) + np.uint64(3))]

    def rows(self, features: list[np.ndarray], klass: np.ndarray | None = None) -> list[np.ndarray]:
        if klass is not None:
            salt = np.take(self.salt, klass)
            features = [((f ^ salt) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32) for f in features]
        return [(f & self.mask).astype(self.kind) for f in features]

    def shares(self, prior: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        """A softmax for each token. Logits stay in the range of the exponential, so none has to be shifted first."""
        logits = np.take(self.weights, rows[0], axis=0)
        for more in rows[1:]:
            logits += np.take(self.weights, more, axis=0)
        logits += prior
        np.clip(logits, -80, 80, out=logits)
        np.exp(logits, out=logits)
        logits /= (logits @ ONES)[:, None]
        return logits

    def _step(self, prior: np.ndarray, rows: list[np.ndarray], target: np.ndarray, frozen: int | None) -> None:
        gradient = self.shares(prior, rows)
        gradient.ravel()[np.arange(0, gradient.size, WIDTH) + target] -= 1
        if frozen is not None:
            gradient[:, frozen] = 0
        for of in rows:
            row, total = _summed(gradient, of)
            steps = np.take(self.steps, row) + np.einsum("ij,ij->i", total, total)
            self.steps[row] = steps
            total *= (RATE / np.sqrt(steps))[:, None]
            self.weights[row] = np.take(self.weights, row, axis=0) - total

    def train(self, hashes: np.ndarray, klass: np.ndarray, place: np.ndarray, at: np.ndarray) -> None:
        """Gradient steps over the tokens at ``at``. The unknown class has no features: it is never seen in training."""
        for i in range(0, len(at), TOKENS_PER_STEP):
            now = at[i : i + TOKENS_PER_STEP]
            features = self.features(hashes, now)
            self._step(self.class_prior, self.rows(features), klass[now], UNKNOWN)
            whose, node, output = self.inside(klass[now], place[now])
            rows = self.rows([np.take(f, whose) for f in features], node)
            self._step(np.take(self.word_prior, node, axis=0), rows, output, None)

    def score(self, hashes: np.ndarray, klass: np.ndarray, place: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 shares of each token's class, and of the unknown class.

        Of head words, that is times the word's share in its class; of other words times what the steps inside the class say
        against the counts, so that the word's counted share of the class is what remains to multiply.
        """
        known, unknown = np.zeros(len(at)), np.zeros(len(at))
        powers = np.exp(np.clip(self.weights, -25, 25))
        counted = self.word_shares.ravel().copy()
        counted[: HEAD_CLASSES * WIDTH] = 1

        def parts(shares: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            """Outputs of a softmax, and the sum they are parts of."""
            found = np.take(powers, rows[0], axis=0)
            found *= shares
            for of in rows[1:]:
                found *= np.take(powers, of, axis=0)
            return found, found @ ONES

        def log(shares: np.ndarray) -> np.ndarray:
            return np.log10(np.maximum(shares, 1e-37))

        for i in range(0, len(at), TOKENS_PER_STEP):
            now, out = at[i : i + TOKENS_PER_STEP], slice(i, i + TOKENS_PER_STEP)
            features = self.features(hashes, now)
            found, whole = parts(self.class_shares, self.rows(features))
            whose, node, output = self.inside(klass[now], place[now])
            within, all_ = parts(np.take(self.word_shares, node, axis=0), self.rows([np.take(f, whose) for f in features], node))
            all_ *= np.take(counted, node * WIDTH + output)
            gain = log(_picked(within, output) / all_)
            known[out] = log(_picked(found, klass[now]) / whole) + np.bincount(whose, gain, len(now))
            unknown[out] = log(found[:, UNKNOWN] / whole)
        return known, unknown


class _Run:
    """Tokens of several texts in one array, each stretch behind its two predecessors."""

    def __init__(self, stretches: list[list[bytes]], lexicon: Lexicon):
        tokens = [word for stretch in stretches for word in stretch]
        sizes = np.array([len(s) for s in stretches])
        ends = np.cumsum(sizes)
        self.at = np.concatenate([np.arange(e - s + 2, e) for s, e in zip(sizes, ends)])
        self.owner = np.repeat(np.arange(len(stretches)), sizes - 2)
        number = np.fromiter(map(lexicon.number.get, tokens, repeat(-1)), np.int64, len(tokens))
        # Words that are not frequent are numbered within the run; ``found`` are their spellings.
        self.rare = np.nonzero(number < 0)[0]
        ids, self.found = pd.factorize(np.array([tokens[i] for i in self.rare.tolist()], object))
        self.ids = np.full(len(tokens), -1)
        self.ids[self.rare] = ids
        self.hashes, self.klass, self.n, self.place = (
            np.append(of, of.dtype.type(0))[number] for of in (lexicon.hashes, lexicon.klass, lexicon.n, lexicon.place)
        )
        for own, of in zip((self.klass, self.place, self.hashes), lexicon.of(list(self.found))):
            own[self.rare] = of[ids]


def _runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[tuple[pa.RecordBatch, int]], list[list[bytes]]]]:
    """Stretches of tokens with the row each is from; long texts give several."""
    rows, stretches, size = [], [], 0
    for batch in batches:
        for i, text in enumerate(batch.column(column).to_pylist()):
            before = [START, START]
            for words in _slices(text):
                if not words:
                    continue
                stretches.append(before + words)
                rows.append((batch, i))
                before = stretches[-1][-2:]
                size += len(words)
                if size >= TOKENS_PER_RUN:
                    yield rows, stretches
                    rows, stretches, size = [], [], 0
    if stretches:
        yield rows, stretches


def _parts(change: np.ndarray) -> Iterator[tuple[int, list[int], bytes]]:
    """The table in parts: which rows changed, and the changed rows as half-precision numbers."""
    for part in range(0, len(change), ROWS_PER_PART):
        rows = change[part : part + ROWS_PER_PART]
        touched = np.nonzero(rows.any(1))[0]
        if len(touched):
            yield part // ROWS_PER_PART, touched.tolist(), rows[touched].astype(np.float16).tobytes()


def _round(texts: DataFrame, counts: Counts, weights: np.ndarray, learners: int) -> np.ndarray:
    """The table after one round: learners start from ``weights``, their changes are averaged row by row."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((counts.class_mass, counts.word_mass, counts.lexicon, weights.astype(np.float16)))
    changed, merged = StructType.fromDDL("part int, rows array<int>, change binary"), StructType.fromDDL("part int, mean binary")
    arrow_changed, arrow_merged = to_arrow_schema(changed), to_arrow_schema(merged)
    parts = -(-len(weights) // ROWS_PER_PART)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_mass, word_mass, lexicon, start = shared.value
        start = start.astype(np.float32)
        network = _Network(class_mass, word_mass, start.copy())
        for _, stretches in _runs(batches, 0):
            run = _Run(stretches, lexicon)
            network.train(run.hashes, run.klass, run.place, run.at)
        for part, rows, change in _parts(network.weights - start):
            yield pa.RecordBatch.from_pydict({"part": [part], "rows": [rows], "change": [change]}, schema=arrow_changed)

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, rows, change in zip(*(column.to_pylist() for column in batch.columns)):
                if part not in sums:
                    sums[part] = np.zeros((ROWS_PER_PART, WIDTH), np.float32), np.zeros(ROWS_PER_PART, np.float32)
                total, times = sums[part]
                total[rows] += np.frombuffer(change, np.float16).reshape(-1, WIDTH)
                times[rows] += 1
        for part, (total, times) in sums.items():
            mean = total / np.maximum(times, 1)[:, None]
            yield pa.RecordBatch.from_pydict({"part": [part], "mean": [mean.astype(np.float16).tobytes()]}, schema=arrow_merged)

    learned = texts.coalesce(learners).mapInArrow(learn, changed)
    # One row per part of the table comes back, the table's size in all.
    means = learned.repartition(parts, "part").mapInArrow(average, merged).collect()
    shared.destroy()
    after = weights.copy()
    for row in means:
        start = row["part"] * ROWS_PER_PART
        mean = np.frombuffer(row["mean"], np.float16).reshape(-1, WIDTH)[: len(weights) - start]
        after[start : start + len(mean)] += mean
    return after


@dataclass(frozen=True)
class Model:
    counts: Counts
    weights: np.ndarray


def learned(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """Counts and weights from the whole ``text`` of every row of ``docs``; a null text is empty."""
    spark = prepared(docs.sparkSession)
    texts = docs.select("text")
    counts = counted(texts)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    learners = max(spark.sparkContext.defaultParallelism, -(-size // (rounds * LEARNER_BYTES)))
    weights = np.zeros((ROWS, WIDTH), np.float32)
    for number in range(rounds if counts.tokens else 0):
        part = texts.where(F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(rounds)) == number)
        weights = _round(part, counts, weights, learners)
    return Model(counts, weights)


STRETCH = """
    _row long, n_tokens long, n_known long, base double, score double,
    words array<string>, tf array<long>, known array<float>, unknown array<float>
"""


def _stretches(docs: DataFrame, model: Model) -> DataFrame:
    """Sums over the tokens whose counts the task knows, and per other word what either outcome would score.

    ``docs`` has ``_row``, ``text`` and ``_keep``, which is handed on.
    """
    counts = model.counts
    shared = docs.sparkSession.sparkContext.broadcast(
        (counts.class_mass, counts.word_mass, counts.lexicon, model.weights.astype(np.float16))
    )
    denominator = counts.tokens + 0.5 * (counts.types + 1)
    schema = StructType([docs.schema["_keep"], *StructType.fromDDL(STRETCH).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_mass, word_mass, lexicon, weights = shared.value
        network = _Network(class_mass, word_mass, weights.astype(np.float32))
        for rows, stretches in _runs(batches, 1):
            tokens = _Run(stretches, lexicon)
            known, unknown = network.score(tokens.hashes, tokens.klass, tokens.place, tokens.at)
            n, klass = tokens.n[tokens.at], tokens.klass[tokens.at]
            here = n > 0
            share = np.where(klass < HEAD_CLASSES, 1, (n + 0.5) / np.maximum(class_mass[klass], 1e-30))
            base = np.where(here, np.log10((n + 0.5) / denominator), 0)
            score = np.where(here, known + np.log10(share), 0)
            size = len(stretches)
            # Other words of a stretch once each: their counts come from the join.
            rest = np.nonzero(~here)[0]
            pair, first, group = np.unique(
                tokens.owner[rest] * len(tokens.found) + tokens.ids[tokens.at][rest], return_index=True, return_inverse=True
            )
            offsets = pa.array(np.searchsorted(pair, np.arange(size + 1) * len(tokens.found)), pa.int32())
            words = pa.array(tokens.found[pair % len(tokens.found)], pa.binary()).cast(pa.string())

            def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
                return pa.ListArray.from_arrays(offsets, pa.array(np.bincount(group, values, len(pair)), kind))

            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column(2).slice(i, 1) for batch, i in rows]).cast(arrow.field("_keep").type),
                    pa.array([batch.column(0)[i].as_py() for batch, i in rows], pa.int64()),
                    pa.array(np.bincount(tokens.owner, minlength=size), pa.int64()),
                    pa.array(np.bincount(tokens.owner, here, size).astype(np.int64)),
                    pa.array(np.bincount(tokens.owner, base, size)),
                    pa.array(np.bincount(tokens.owner, score, size)),
                    pa.ListArray.from_arrays(offsets, words),
                    lists(np.ones(len(rest)), pa.float64()).cast(pa.list_(pa.int64())),
                    lists(known[rest], pa.float32()),
                    lists(unknown[rest], pa.float32()),
                ],
                schema=arrow,
            )

    return docs.mapInArrow(run, schema)


def scored(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``score`` is the log10 probability of the whole text and its end under the model, ``base_score`` under the plain word
    distribution of the training texts; both treat unknown words as one type. A null text is empty: its only token is the
    end. Repeated rows are scored each; other columns are ignored. Without training texts every token is unknown, and
    certain. Names of ``keep`` must not be those of the new columns.
    """
    prepared(docs.sparkSession)
    counts = model.counts
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), "text", F.struct(*keep).alias("_keep"))
    # Numbers of rows hold only within one reading, so what belongs together is written together.
    rows = materialised(_stretches(numbered, model))
    sums = [F.col(c) for c in ("_row", "_keep", "n_tokens", "n_known", "base", "score")]
    each = rows.select("_row", F.explode(F.arrays_zip("words", "tf", "known", "unknown")).alias("_w")).select("_row", "_w.*")
    n = F.coalesce(F.col("n"), F.lit(0))
    rest = F.lit(float(max(counts.class_mass[REST], 1e-30)))
    total = counts.tokens + 0.5 * (counts.types + 1)
    others = each.join(counts.words.withColumnRenamed("word", "words"), "words", "left").select(
        "_row",
        F.lit(None).cast(rows.schema["_keep"].dataType).alias("_keep"),
        F.lit(0).cast("long").alias("n_tokens"),
        F.when(n > 0, F.col("tf")).otherwise(0).alias("n_known"),
        (F.col("tf") * F.log10((n + 0.5) / total)).alias("base"),
        F.when(n > 0, F.col("known") + F.col("tf") * F.log10((n + 0.5) / rest))
        .otherwise(F.col("unknown").cast("double"))
        .alias("score"),
    )
    return (
        rows.select(*sums)
        .unionByName(others)
        .groupBy("_row")
        .agg(
            F.first("_keep", ignorenulls=True).alias("_keep"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum("n_known").alias("n_known"),
            F.sum("base").alias("base_score"),
            F.sum("score").alias("score"),
        )
        .select("_keep.*", "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")
    )
