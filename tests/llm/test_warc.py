import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from parcelwise.llm import warc


@pytest.fixture
def pages(session):
    return lambda *rows: session.createDataFrame(rows, "page_id long, url string, html string")


def by_id(df):
    return sorted((r["page_id"] or -1, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in df.collect())


def test_round_trip(pages, session, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{'ä' * (i % 5)}{i % 7}</p>") for i in range(60)]
    rows += [(100, None, None), (101, "http://x", ""), (None, "http://y", "<p>0</p>"), (102, "bad\r\nurl", "x\r\n\r\ny\0" * 3)]
    path = warc.write(pages(*rows).withColumn("digest", F.lit("own")).repartition(3), str(tmp_path / "a"), archive_bytes=2000)
    found = warc.read(session, path).collect()
    assert len(found) == len(rows)
    payload = {i: (h or "").encode() for i, _, h in rows}
    largest = {}
    for i, h in payload.items():
        largest[h] = max(largest.get(h, -1), -1 if i is None else i)
    for r in found:
        whole = payload[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(whole), warc.digest(whole))
        if r["page_id"] == largest[whole]:
            assert r["record_type"] == "response" and r["refers_to"] is None and bytes(r["payload"]) == whole
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == largest[whole] and r["payload"] is None
    assert len({r["archive"] for r in found}) > 3
    assert {r["url"] for r in found if r["page_id"] in (100, 102)} == {"urn:unknown", "badurl"}
    # Every file is a sequence of gzip members for any other reader too.
    for file in (tmp_path / "a").glob("part-*"):
        content = file.read_bytes()
        places = sorted((r["offset"], r["length"]) for r in found if r["archive"].endswith(file.name))
        assert gzip.decompress(content).count(b"WARC/1.1\r\n") == len(places)
        assert [a + n for a, n in places] == [a for a, _ in places][1:] + [len(content)]


def test_least_bytes_ties_and_empty(pages, session, tmp_path):
    rows = [(1, "u", "aa"), (2, "u", "aa"), (2, "u", "aa"), (3, "u", "b"), (4, "u", "b"), (None, "u", "c"), (None, "u", "c")]
    path = warc.write(pages(*rows), str(tmp_path / "a"), least_bytes=2)
    kinds = [(r[0], r[1], r[2]) for r in by_id(warc.read(session, path, payloads=False))]
    assert kinds == [(-1, "response", None)] * 2 + [(1, "revisit", 2)] + [(i, "response", None) for i in (2, 2, 3, 4)]
    path = warc.write(pages(*rows).limit(0), str(tmp_path / "b"))
    assert warc.read(session, path).count() == 0


def test_large_members():
    payload = b"x" * (17 << 20)
    made = warc.response(1, "u", payload)
    assert made[-1] and warc._stored(made) == made
    (first, second) = warc.records(made + b"\0" + warc.response(2, "u", b"y"))
    assert first.payload == payload and second.payload == b"y"


@pytest.mark.parametrize("damage", ["cut", "flip", "length", "digest"])
def test_damage_is_found(damage):
    good = warc.response(1, "http://a", b"some payload")
    raw = zlib.decompress(good, 31)
    bad = {
        "cut": good[:-9],
        "flip": good[:40] + bytes([good[40] ^ 255]) + good[41:],
        "length": gzip.compress(raw.replace(b"Content-Length: ", b"Content-Length: 1")),
        "digest": gzip.compress(raw.replace(b"some payload", b"same payload")),
    }[damage]
    with pytest.raises(warc.DamagedArchive):
        list(warc.records(bad))
