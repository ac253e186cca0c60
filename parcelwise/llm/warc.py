"""WARC archives: writing pages as records, and a sequential reader.

An archive is a file of gzip members, one per record. Spark's text writer stores the members on any file system Spark
can write to: rows are bytes, and the line separator, a zero byte, stands for the last byte of a member, which is
the high byte of its uncompressed length and zero below 16 MB. Larger members are followed by a zero byte
instead, which the reader skips as padding, as gzip itself does.

The reader walks through an archive record by record: it inflates one member step by step, frames the block by its
content length and compares block and payload with their digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parcelwise.llm.shared import ROWS_PER_BATCH, arrow_map

VERSION = b"WARC/1.1"
# The date of all records, so that archives of the same pages are the same bytes.
DATE = "2025-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
# Bytes of members after which a new archive begins: a reader holds one archive at a time.
ARCHIVE_BYTES = 16 << 20
# Bytes handed to the decompressor, and bytes it may return, at a time.
STEP = 1 << 16


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{sha}')}>"


def _member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member."""
    lines = [VERSION.decode(), *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    parts = ("\r\n".join(lines).encode("utf-8", "replace"), block, b"\r\n\r\n")
    return b"".join([*map(packer.compress, parts), packer.flush()])


def _headers(kind: str, page_id: int | None, url: str | None, payload: bytes, block: bytes) -> list[tuple[str, str]]:
    sha = digest(payload)
    return [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, sha)),
        ("WARC-Date", DATE),
        # Control characters would end the header.
        ("WARC-Target-URI", "".join(c for c in url or "urn:unknown" if c.isprintable())),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]


def response(page_id: int | None, url: str | None, payload: bytes) -> bytes:
    """The record that holds a page."""
    block = HTTP_HEAD + payload
    return _member(_headers("response", page_id, url, payload, block), block)


def revisit(page_id: int | None, url: str | None, payload: bytes, original: int) -> bytes:
    """The record of a page whose payload is held by the response of page ``original``."""
    refers = [
        ("WARC-Profile", REVISIT_PROFILE),
        ("WARC-Refers-To", record_id(original, digest(payload))),
        ("X-Refers-To-Page-ID", str(original)),
    ]
    return _member(_headers("revisit", page_id, url, payload, HTTP_HEAD) + refers, HTTP_HEAD)


@dataclass
class Record:
    """One record: its headers (names in lower case), block, payload and the place of its member."""

    headers: dict[str, str]
    block: bytes
    payload: bytes
    offset: int
    length: int


class DamagedArchive(ValueError):
    """An archive whose framing or digests do not hold."""


def _inflated(archive: memoryview, start: int) -> Iterator[bytes | int]:
    """The contents of the member at ``start`` in bounded pieces, and at last the place behind it."""
    unpack, at = zlib.decompressobj(31), start
    while not unpack.eof:
        chunk = unpack.unconsumed_tail
        if not chunk:
            chunk = archive[at : at + STEP]
            at += len(chunk)
            if not chunk:
                raise DamagedArchive(f"member at {start} is cut off")
        try:
            piece = unpack.decompress(chunk, STEP)
        except zlib.error as error:
            raise DamagedArchive(f"member at {start}: {error}") from error
        if piece:
            yield piece
    yield at - len(unpack.unused_data)


def records(archive: bytes) -> Iterator[Record]:
    """The records of an archive in order; raises ``DamagedArchive`` where framing or digests do not hold."""
    view, at = memoryview(archive), 0
    while at < len(view):
        if view[at] == 0:  # padding between members
            at += 1
            continue
        start, held, headers, length = at, bytearray(), None, 0
        for piece in _inflated(view, start):
            if isinstance(piece, int):
                at = piece
                break
            held += piece
            if headers is None and (end := held.find(b"\r\n\r\n")) >= 0:
                lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
                if lines[0].encode() != VERSION:
                    raise DamagedArchive(f"no record at {start}")
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                length = int(headers["content-length"])
                del held[: end + 4]
            if headers is not None and len(held) > length + 4:
                raise DamagedArchive(f"record at {start} is longer than its content length")
        if headers is None or len(held) != length + 4 or held[length:] != b"\r\n\r\n":
            raise DamagedArchive(f"record at {start} does not have its content length")
        block = bytes(held[:length])
        payload = block.partition(b"\r\n\r\n")[2]
        if headers["warc-block-digest"] != f"sha1:{digest(block)}":
            raise DamagedArchive(f"block digest of the record at {start}")
        if headers["warc-type"] == "response" and headers["warc-payload-digest"] != f"sha1:{digest(payload)}":
            raise DamagedArchive(f"payload digest of the record at {start}")
        yield Record(headers, block, payload, start, at - start)


def _stored(archive: bytes) -> bytes:
    """What the text writer gets for an archive: it adds a zero byte, the last one of nearly every member."""
    return archive[:-1] if archive[-1] == 0 else archive


def write(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write a record per row of ``pages`` (``page_id``, ``url``, ``html``) to archives under ``path``; returns ``path``.

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the largest ``page_id`` becomes a response,
    the others become revisits of it; rows that repeat its id are responses too. Pages without an id are
    revisits of a page with one; if none has an id, all are responses. A null ``html`` is an empty payload, a null
    ``url`` becomes ``urn:unknown``. Other columns are ignored. An empty table writes no archive.

    Only digests are grouped, with map-side combine; a payload that most pages share is one row of the joined side.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    given = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"))
    # Equal bytes, told apart by two digests.
    key = (F.sha1("html"), F.xxhash64("html"))
    shared = (
        given.where(F.octet_length("html") >= least_bytes)
        .select("page_id", key[0].alias("sha"), key[1].alias("xx"))
        .groupBy("sha", "xx")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    joined = given.select("*", key[0].alias("sha"), key[1].alias("xx")).join(shared, ["sha", "xx"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for page_id, url, payload, original in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if original is None or original == page_id:
                    made = response(page_id, url, payload)
                else:
                    made = revisit(page_id, url, payload, original)
                if held and size + len(made) > archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([_stored(b"".join(held))], pa.binary())], ["archive"])
                    held, size = [], 0
                held.append(made)
                size += len(made)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_stored(b"".join(held))], pa.binary())], ["archive"])

    archives = joined.select("page_id", "url", "html", "original").mapInArrow(run, "archive binary")
    # One row to a file: the writer streams its bytes as they are.
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option(
        "maxRecordsPerFile", 1
    ).text(path)
    return path


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under ``path``; damaged archives fail the job.

    One row per record: ``page_id``, ``url``, ``record_type``, ``record_id``, ``refers_to`` (page id of the response that
    a revisit refers to), ``payload_bytes``, ``payload_digest`` (both of the full payload), ``archive``, ``offset``,
    ``length`` and, if asked for, ``payload`` (null for revisits).
    """
    fields = (
        "page_id long, url string, record_type string, record_id string, refers_to long, payload_bytes long, "
        "payload_digest string, archive string, offset long, length long"
    ) + ", payload binary" * payloads

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                out: dict[str, list] = {f.name: [] for f in target.fields}
                held = 0
                for r in records(content):
                    h = r.headers
                    kind = h["warc-type"]
                    found = {
                        "page_id": int(h["x-page-id"]) if h["x-page-id"] else None,
                        "url": h["warc-target-uri"],
                        "record_type": kind,
                        "record_id": h["warc-record-id"],
                        "refers_to": int(h["x-refers-to-page-id"]) if kind == "revisit" else None,
                        "payload_bytes": len(r.payload) if kind == "response" else int(h["x-payload-length"]),
                        "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"),
                        "archive": path,
                        "offset": r.offset,
                        "length": r.length,
                        "payload": r.payload if kind == "response" else None,
                    }
                    for name in out:
                        out[name].append(found[name])
                    held += len(r.payload) if payloads else 0
                    if len(out["page_id"]) >= ROWS_PER_BATCH or held > STEP * 64:
                        yield out
                        out, held = {name: [] for name in out}, 0
                yield out

    target = StructType.fromDDL(fields)
    # Hidden and empty files aside, every file of the folder is an archive.
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return arrow_map(files, fields, rows)
