import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parcelwise.llm import bpe
from parcelwise.llm.queries import TOKENIZER

PARTS = ["a", "b", "'s", "'LL", "’", "Σ", "ς", "İ", "ß", " ", "\n", "\x1c", "\x85", "\xa0", "　", "é", "日本", "1", "½", "🙂"]
PARTS += ["👩‍👩‍👧", "<|startoftext|>", "<|endoftext|>", "<|", "|>", "##", "\x00", "ﬁ", "א", "ǅ", "x" * 70, "ab" * 80, "Don't"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def encoder():
    with open(TOKENIZER, encoding="utf-8") as file:
        return bpe.Encoder(file.read())


def test_like_the_library(library, encoder):
    rnd = random.Random(2)
    for _ in range(3000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids, text
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_scan_and_heap_agree(encoder):
    rnd = random.Random(3)
    for _ in range(300):
        raw = [rnd.choice("thineraosd") for _ in range(rnd.randint(1, 120))]
        raw[-1] += "</w>"
        assert encoder._scan(raw) == encoder._heap(raw)


def test_remembered_words_are_bounded(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    encoder.known.clear()
    encoder.encode(" ".join(f"word{i}" for i in range(50)))
    assert len(encoder.known) <= 3


def test_documents(library, session, small):
    docs = session.read.parquet(f"{small}/documents.parquet")
    found = {r["doc_id"]: r for r in bpe.token_digests(bpe.encoded(docs, TOKENIZER)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc in docs.collect():
        ids = library.encode(doc["text"] or "", add_special_tokens=False).ids
        r = found.pop(doc["doc_id"])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))
    assert not found


def test_edge_cases(documents):
    docs = documents((None, "a b"), (1, None), (2, ""), (2, "  \n"), (3, "w" * 30_000)).withColumn("ids", F.lit("own"))
    found = bpe.encoded(docs, TOKENIZER).collect()
    assert [len(r["ids"]) for r in found][:4] == [2, 0, 0, 0] and len(found) == 5
    digests = bpe.token_digests(bpe.encoded(docs, TOKENIZER)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert (digests[1]["n_tokens"], digests[1]["ids_sha256"], digests[1]["decoded_sha256"]) == (0, empty, empty)
    assert bpe.encoded(docs.limit(0), TOKENIZER).count() == 0
