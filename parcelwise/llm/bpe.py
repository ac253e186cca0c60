"""Byte-pair encoding of whole texts with a public vocabulary, and decoding.

A word is encoded in one array of its parts, as numbers, and one array of the ranks of adjacent parts: the smallest rank
is looked for, its boundary deleted and the two neighbouring ranks looked up again, until no pair has a rank. Long
words use a heap over the same parts, since repeated scans would take quadratic time. A Python worker keeps the encoder
and the words it has encoded, up to a fixed number.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Words with more parts are merged through a heap.
SHORT_WORD = 48
# Words a task remembers.
REMEMBERED = 400_000
NO_RANK = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the other bytes for the characters from 256 on, in order.
    """
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    symbols, following = [""] * 256, 256
    for byte in range(256):
        if byte in shown:
            symbols[byte] = chr(byte)
        else:
            symbols[byte] = chr(following)
            following += 1
    return symbols


class Remembered(dict):
    """Results by argument, made where they are missing; a hit runs no Python code. Cleared when it is full."""

    def __init__(self, make: Callable[[str], list[int]]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> list[int]:
        found = self.make(key)
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = found
        return found


class Encoder:
    """Encoder and decoder of one tokenizer definition: word BPE with an end-of-word suffix.

    Supported are the parts such definitions have: NFC, white-space folding and lower-casing, a split pattern of which
    the matches are kept, byte-level symbols, and special tokens that are found in the raw text.
    """

    def __init__(self, definition: str) -> None:
        parsed = json.loads(definition)
        model = parsed["model"]
        steps = [s["type"] for s in parsed["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a lower-casing word BPE definition")
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.pattern = regex.compile(parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.spaces = regex.compile(parsed["normalizer"]["normalizers"][1]["pattern"]["Regex"])
        special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.special = special
        self.marks = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.names = {i: token for token, i in (self.ids | special).items()}
        self.symbols = byte_symbols()
        # Parts as numbers: tokens by their id, symbols that are no tokens behind them.
        self.number = dict(self.ids)
        for symbol in [*self.symbols, *(symbol + self.suffix for symbol in self.symbols)]:
            self.number.setdefault(symbol, len(self.ids) + len(self.number))
        self.inner = [self.number[symbol] for symbol in self.symbols]
        self.last = [self.number[symbol + self.suffix] for symbol in self.symbols]
        self.width = max(self.number.values()) + 1
        # A pair as one number -> rank; the rank -> what the pair becomes.
        self.pair_rank = {
            self.number[a] * self.width + self.number[b]: rank for (a, b), rank in self.ranks.items() if a + b in self.number
        }
        self.becomes = [self.number.get(a + b, -1) for a, b in self.ranks]
        self.words = Remembered(self.merged)
        self.known = Remembered(self.chunk)

    def normalised(self, text: str) -> str:
        text = self.spaces.sub(" ", unicodedata.normalize("NFC", text))
        # Lower-casing goes character by character: no final form of sigma.
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def merged(self, word: str) -> list[int]:
        """The ids of one word."""
        raw = word.encode("utf-8", "surrogatepass")
        if len(raw) > SHORT_WORD:
            symbols = [self.symbols[b] for b in raw]
            symbols[-1] += self.suffix
            return [self.ids[part] for part in self._heap(symbols)]
        parts = list(map(self.inner.__getitem__, raw))
        parts[-1] = self.last[raw[-1]]
        self._merge(parts)
        # Symbols that are no tokens have no id.
        return parts if max(parts) < len(self.ids) else [self.ids[self.names[part]] for part in parts]

    def _merge(self, parts: list[int]) -> None:
        """Merge adjacent parts in place, the pair of the smallest rank first, the leftmost of equal ones."""
        rank_of, width, becomes = self.pair_rank.get, self.width, self.becomes
        ranks = [rank_of(a * width + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            part = parts[i] = becomes[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] * width + part, NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of(part * width + parts[i + 1], NO_RANK)

    def _scan(self, raw: list[str]) -> list[str]:
        """``_merge`` for parts given by their spelling."""
        parts = [self.number[symbol] for symbol in raw]
        self._merge(parts)
        return [self.names[part] for part in parts]

    def _heap(self, raw: list[str]) -> list[str]:
        parts: list[str | None] = list(raw)
        n, rank_of = len(raw), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                rank = rank_of((parts[i], parts[after[i]]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i, parts[i], parts[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            if parts[i] != left or after[i] >= n or parts[after[i]] != right:
                continue
            gone = after[i]
            parts[i], parts[gone] = left + right, None
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [p for p in parts if p is not None]

    def chunk(self, chunk: str) -> list[int]:
        """The ids of a normalised run without white space."""
        words = self.pattern.findall(chunk)
        return self.words[words[0]] if len(words) == 1 else list(chain.from_iterable(map(self.words.__getitem__, words)))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text; null counts as empty."""
        ids: list[int] = []
        for piece in self.marks.split(text or "") if self.marks else [text or ""]:
            if piece in self.special:
                ids.append(self.special[piece])
            elif piece:
                ids.extend(chain.from_iterable(map(self.known.__getitem__, self.normalised(piece).split(" "))))
        return ids

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by blanks, which is how a definition without a decoder decodes."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=1)
def _encoder(definition: str) -> Encoder:
    """The encoder of a Python worker, which its tasks share."""
    return Encoder(definition)


def encoded(docs: DataFrame, path: str, carried: Sequence[str] = ()) -> DataFrame:
    """(``doc_id``, ``ids`` array, ``decoded``): every whole text as tokens, and the text the tokens decode to.

    The columns named in ``carried`` follow unchanged.

    ``path`` names the tokenizer definition on the driver, which sends it to the tasks once (a file of fixed size). A
    null text counts as empty: no ids, empty decoded text. Rows with null or repeated ids keep one row each; other
    columns are ignored; an empty table gives an empty result.
    """
    with open(path, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        for batch in batches:
            lists = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)])
            flat = np.fromiter(chain.from_iterable(lists), np.int32, ends[-1])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            decoded = pa.array(list(map(encoder.decode, lists)), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, decoded, *batch.columns[2:]], ["doc_id", "ids", "decoded", *carried]
            )

    given = docs.select(F.col("doc_id").cast("long"), "text", *carried)
    schema = StructType.fromDDL("doc_id long, ids array<int>, decoded string")
    return given.mapInArrow(run, StructType(schema.fields + given.schema.fields[2:]))


def token_digests(tokens: DataFrame) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text, from the result of ``encoded``."""
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
