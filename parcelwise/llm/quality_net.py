"""Quality classifier: a convolutional network over the bytes of a text, in numpy.

A text is cut into overlapping chunks that cover it whole. Bytes are embedded, filters of ``WIDTH`` bytes run over each chunk, and
each filter's largest response in the chunk is kept. The chunk values of a text are combined by their maximum and
their mean, and one logistic unit turns these into a probability.

The network is fitted on the driver to a bounded sample of labelled texts (``SAMPLE`` per class, a bounded number of chunks
each), and sent to the tasks, which score every chunk of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.shared import arrow_map

CHUNK = 256
STRIDE = 224
WIDTH = 5
DEPTH = 4
FILTERS = 24
# Labelled texts per class and chunks per text in the fitted sample.
SAMPLE = 3000
SAMPLE_CHUNKS = 12
# Steps of the fit, and texts of a step, half of them of either class.
STEPS = 700
BATCH = 32
RATE = 0.01
DECAY = 1e-4
# Chunks scored at once.
CHUNKS_AT_ONCE = 256


def chunks(text: str | None) -> np.ndarray:
    """The overlapping chunks of a text as rows of bytes; blanks fill up the last one. There is always one."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    count = max(1, -(-(len(data) - CHUNK) // STRIDE) + 1)
    padded = np.full((count - 1) * STRIDE + CHUNK, 32, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STRIDE]


@dataclass
class Network:
    """The parameters, all arrays."""

    bytes: np.ndarray  # 256 x DEPTH
    filters: np.ndarray  # WIDTH * DEPTH x FILTERS
    offsets: np.ndarray  # FILTERS
    output: np.ndarray  # 2 * FILTERS + 1, the last one the constant

    @classmethod
    def initial(cls, seed: int) -> Network:
        rnd = np.random.default_rng(seed)
        return cls(
            (0.5 * rnd.standard_normal((256, DEPTH))).astype(np.float32),
            (rnd.standard_normal((WIDTH * DEPTH, FILTERS)) / np.sqrt(WIDTH * DEPTH)).astype(np.float32),
            np.zeros(FILTERS, np.float32),
            (0.1 * rnd.standard_normal(2 * FILTERS + 1)).astype(np.float32),
        )

    def columns(self, rows: np.ndarray) -> np.ndarray:
        """Embedded neighbourhoods of every filter place, chunk by chunk."""
        embedded = self.bytes[rows]
        wide = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH, axis=1)
        return np.ascontiguousarray(wide.swapaxes(2, 3)).reshape(-1, WIDTH * DEPTH)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each chunk, without negative values."""
        out = np.empty((len(rows), FILTERS), np.float32)
        for start in range(0, len(rows), CHUNKS_AT_ONCE):
            part = rows[start : start + CHUNKS_AT_ONCE]
            responses = (self.columns(part) @ self.filters).reshape(len(part), -1, FILTERS)
            out[start : start + len(part)] = np.maximum(responses.max(axis=1) + self.offsets, 0)
        return out

    def scores(self, texts: list[str | None]) -> list[float]:
        """Probability of each text."""
        pieces = [chunks(t) for t in texts]
        starts = np.cumsum([0, *map(len, pieces)])[:-1]
        if not len(starts):
            return []
        values = np.empty((starts[-1] + len(pieces[-1]), FILTERS), np.float32)
        # Chunks of several texts go through the filters together, without one large copy of all of them.
        held, at = [], 0
        for i, piece in enumerate(pieces):
            held.append(piece)
            size = sum(map(len, held))
            if size >= CHUNKS_AT_ONCE or i == len(pieces) - 1:
                values[at : at + size] = self.pooled(np.concatenate(held) if len(held) > 1 else piece)
                held, at = [], at + size
        counts = np.diff(np.r_[starts, len(values)])[:, None]
        joined = np.hstack([np.maximum.reduceat(values, starts), np.add.reduceat(values, starts) / counts])
        logits = joined.astype(np.float64) @ self.output[:-1] + self.output[-1]
        return (1 / (1 + np.exp(-np.clip(logits, -30, 30)))).tolist()

    def gradients(self, rows: np.ndarray, starts: np.ndarray, target: np.ndarray) -> tuple[Network, float]:
        """Gradients of the mean log loss of some texts (chunks ``rows``, first chunk of each text) and the loss."""
        columns = self.columns(rows)
        responses = (columns @ self.filters).reshape(len(rows), -1, FILTERS)
        best = responses.argmax(axis=1)
        top = np.take_along_axis(responses, best[:, None], axis=1)[:, 0] + self.offsets
        values = np.maximum(top, 0)
        counts = np.diff(np.r_[starts, len(rows)])
        owner = np.repeat(np.arange(len(starts)), counts)
        highest = np.maximum.reduceat(values, starts)
        mean = np.add.reduceat(values, starts) / counts[:, None]
        joined = np.hstack([highest, mean, np.ones((len(starts), 1), np.float32)])
        p = 1 / (1 + np.exp(-np.clip(joined @ self.output, -30, 30)))
        loss = -float(np.log(np.where(target > 0, p, 1 - p) + 1e-9).mean())
        slope = ((p - target) / len(target)).astype(np.float32)
        d_output = joined.T @ slope
        d_joined = slope[:, None] * self.output[None, :-1]
        # The maximum passes its slope on to the first chunk that attains it, the mean to all.
        ties = values == highest[owner]
        before = np.cumsum(ties, axis=0) - ties
        first = ties & (before - before[starts][owner] == 0)
        d_values = np.where(first, d_joined[owner, :FILTERS], 0) + d_joined[owner, FILTERS:] / counts[owner, None]
        d_top = np.where(top > 0, d_values, 0).astype(np.float32)
        place = (np.arange(len(rows))[:, None] * responses.shape[1] + best).ravel()
        touched = columns[place].reshape(len(rows), FILTERS, WIDTH * DEPTH)
        d_filters = np.einsum("cf,cfk->kf", d_top, touched)
        d_columns = (d_top[:, :, None] * self.filters.T[None]).reshape(-1, WIDTH, DEPTH)
        position = best[:, :, None] + np.arange(WIDTH)
        used = rows[np.arange(len(rows))[:, None, None], position].reshape(-1, WIDTH)
        d_bytes = np.zeros_like(self.bytes)
        np.add.at(d_bytes, used, d_columns)
        return Network(d_bytes, d_filters, d_top.sum(axis=0), d_output), loss


def fit(texts: list[np.ndarray], target: np.ndarray, share: float, seed: int = 5, steps: int = STEPS) -> Network:
    """A network fitted with Adam to chunked texts and their 0/1 targets.

    Steps see both classes equally; ``share``, the share of class 1 among all labels, is put into the constant at the end.
    """
    network, rnd = Network.initial(seed), np.random.default_rng(seed)
    names = [f.name for f in fields(Network)]
    first = {n: np.zeros_like(getattr(network, n)) for n in names}
    second = {n: np.zeros_like(getattr(network, n)) for n in names}
    classes = [np.flatnonzero(target == c) for c in (0, 1)]
    for turn in range(1, steps + 1):
        part = np.concatenate([rnd.choice(c, BATCH // 2) for c in classes])
        rows = np.concatenate([texts[i] for i in part])
        starts = np.cumsum([0, *(len(texts[i]) for i in part)])[:-1]
        slopes, _ = network.gradients(rows, starts, target[part])
        rate = RATE * (1 - turn / (steps + 1))
        for n in names:
            value, slope = getattr(network, n), getattr(slopes, n) + DECAY * getattr(network, n)
            first[n] = 0.9 * first[n] + 0.1 * slope
            second[n] = 0.999 * second[n] + 0.001 * slope**2
            change = first[n] / (1 - 0.9**turn) / (np.sqrt(second[n] / (1 - 0.999**turn)) + 1e-8)
            value -= (rate * change).astype(np.float32)
    network.output[-1] += np.log(share / (1 - share))
    return network


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Chunks and target of at most ``sample`` labelled texts per class (up to ``SAMPLE_CHUNKS`` chunks each), share of label 1.

    ``labels`` has ``doc_id`` and ``label``.
    """
    clean = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    drawn = None
    counts = {r["label"]: r["n"] for r in clean.groupBy("label").agg(F.count("*").alias("n")).collect()}
    for label in (0, 1):
        own = clean.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        drawn = own if drawn is None else drawn.unionByName(own)
    # At most two times `sample` rows.
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(drawn), "doc_id")

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            picked = []
            for text in batch["text"]:
                pieces = chunks(text)
                spread = np.unique(np.linspace(0, len(pieces) - 1, SAMPLE_CHUNKS).astype(int))
                picked.append(pieces[spread].tobytes())
            yield {"doc_id": batch["doc_id"], "label": batch["label"], "chunks": picked}

    found = arrow_map(texts, "doc_id long, label int, chunks binary", rows).collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["chunks"])))
    target = np.array([r["label"] for r in found], np.float32)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return [np.frombuffer(r["chunks"], np.uint8).reshape(-1, CHUNK) for r in found], target, share


def scored(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, seed: int = 5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``score``, the probability of label 1.

    ``labels`` has ``doc_id`` and ``label`` (0, 1, others are ignored; a document with both counts as 0). Only labels for
    which the column expression ``learn`` holds are learned from; nothing but the text enters a score. A null or empty text is
    a chunk of blanks. With labels of one class only every score is that class, without labels 0.5. Null and
    repeated ids keep their rows; other columns are ignored; an empty table gives an empty result.
    """
    texts, target, share = training_sample(docs, labels.where(learn), sample)
    classes = set(target.tolist())
    network = fit(texts, target, share, seed) if len(classes) == 2 else None
    fixed = classes.pop() if len(classes) == 1 else 0.5
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            model = sent.value
            scores = model.scores(batch["text"]) if model else [fixed] * len(batch["text"])
            yield {"doc_id": batch["doc_id"], "score": scores}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, score double", rows)
