"""Operator 5: WARC records in seekable Zstandard bundles.

Pages become WARC/1.1 records; equal payloads of at least ``MIN_REVISIT`` bytes
are stored once (the smallest page id) and the others are ``revisit`` records
that refer to it.  A bundle is a file of independent Zstandard frames, each
holding whole records up to ``FRAME_BYTES``, followed by a seek table in a
skippable frame (the public seekable format: compressed and decompressed size of
every frame, their number, a descriptor byte and a magic number).  The index
maps each page to its bundle, frame, offset inside the frame and length, so one
record is read by decompressing one frame.

Layout of the work:

* decisions: payload hashes are computed in the JVM and pre-aggregated; only the
  hashes of repeated payloads are joined back, never the payloads;
* writing: pages meet their decisions by page id (unique, so no hot key), each
  task streams its rows into bundles of bounded size;
* a bundle file has a fresh name, and only the index rows of tasks that
  committed name it, so a task that runs twice leaves an unused file at most;
* reading: index rows are grouped by bundle and frame, each frame is
  decompressed once.

Bundles go through ``pyarrow.fs``, so the folder may be any store that it knows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, table
from quarry.session import materialize, scratch_path

MIN_REVISIT = 100
FRAME_BYTES = 1 << 20       # records grouped into one frame, before compression
BUNDLE_BYTES = 256 << 20    # compressed size from which a new bundle begins
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"   # records carry a fixed date: equal input gives equal bytes

SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
INDEX = ("page_id long, url string, bundle string, frame int, frame_offset long, frame_bytes long, "
         "record_offset long, record_bytes long")
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def open_store(path: str):
    """(filesystem, path inside it) of a folder or file named by URI or local path."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path[5:] if path.startswith("file:") else path


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, kind: str,
           refers_to: int | None) -> bytes:
    """One WARC record.  A revisit has no block; its headers carry the full payload's digest and size."""
    block = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record length does not match")
    return fields, rest[:size]


class Bundle:
    """Writes frames to one file and its seek table at the end."""

    def __init__(self, folder: str):
        store, base = open_store(folder)
        self.path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.zst"
        store.create_dir(base, recursive=True)
        self.out = store.open_output_stream(f"{base.rstrip('/')}/{self.path.rsplit('/', 1)[1]}", compression=None)
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.table: list[tuple[int, int]] = []
        self.size = 0

    def frame(self, data: bytes) -> tuple[int, int, int]:
        """(number, offset, compressed size) of the frame written."""
        packed = self.zip.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data)))
        self.size += len(packed)
        return len(self.table) - 1, self.size - len(packed), len(packed)

    def close(self) -> None:
        body = b"".join(struct.pack("<II", *x) for x in self.table)
        body += struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


def seek_table(path: str) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of every frame, from a bundle's footer."""
    store, inner = open_store(path)
    with store.open_input_file(inner) as f:
        end = f.size()
        f.seek(end - 9)
        frames, descriptor, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE or descriptor & 0x7C:
            raise ValueError("no seek table")
        width = 12 if descriptor & 0x80 else 8
        f.seek(end - 9 - frames * width - 8)
        if struct.unpack("<II", f.read(8)) != (SKIPPABLE, frames * width + 9):
            raise ValueError("seek table is damaged")
        body = f.read(frames * width)
    out, at = [], 0
    for k in range(frames):
        packed, plain = struct.unpack_from("<II", body, k * width)
        out.append((at, packed, plain))
        at += packed
    return out


def _hashed(pages: DataFrame) -> DataFrame:
    url = pages["url"].cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    return pages.select(pages["page_id"].cast("long").alias("page_id"), url.alias("url"),
                        payload.alias("payload"), F.sha2(payload, 256).alias("digest"))


def decisions(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that become revisits.

    Of equal payloads of at least ``min_bytes`` the row with the smallest page
    id is the response.  Null page ids take no part.
    """
    rows = (_hashed(pages).where(F.octet_length("payload") >= min_bytes).where("page_id IS NOT NULL")
            .select("page_id", "digest"))
    first = (rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
             .where("last > refers_to").select("digest", "refers_to"))
    return rows.join(first, "digest").where("page_id > refers_to").dropDuplicates(["page_id", "digest"])


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT, frame_bytes: int = FRAME_BYTES,
          bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record per row into bundles under ``folder``; returns the index.

    A null html is an empty payload.  Rows with a null page id are responses.
    Of rows that repeat a page id each has a record of its own; they are
    responses or revisits by their own payload.  Columns other than page_id,
    url (may be missing) and html are ignored; an empty table writes nothing.
    """
    later = decisions(pages, min_bytes).withColumnsRenamed({"page_id": "__id", "digest": "__digest"})
    rows = _hashed(pages)
    rows = rows.join(later, (rows["page_id"] == later["__id"]) & (rows["digest"] == later["__digest"]), "left")
    rows = rows.select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder, frame_bytes, bundle_bytes)
        for batch in batches:
            for page_id, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = "response" if refers is None else "revisit"
                writer.add(page_id, url, record(page_id, url, payload, digest, len(payload), kind, refers))
            yield from writer.finished()
        writer.close()
        yield from writer.finished()

    # materialised: the files are written once, and the index names those of committed tasks only
    return materialize(small_batches(rows).mapInArrow(run, INDEX), "warc-index")


class _Writer:
    """Collects records into frames and frames into bundles of bounded size."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int):
        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.bundle: Bundle | None = None
        self.frame: list[bytes] = []
        self.size = 0
        self.waiting: list[tuple] = []      # (page_id, url, offset in the frame, length)
        self.done: list[tuple] = []

    def add(self, page_id, url, data: bytes) -> None:
        if self.frame and self.size + len(data) > self.frame_bytes:
            self.flush()
        self.waiting.append((page_id, url, self.size, len(data)))
        self.frame.append(data)
        self.size += len(data)

    def flush(self) -> None:
        if self.bundle is None:
            self.bundle = Bundle(self.folder)
        number, offset, packed = self.bundle.frame(b"".join(self.frame))
        self.done += [(p, u, self.bundle.path, number, offset, packed, o, n) for p, u, o, n in self.waiting]
        self.frame, self.size, self.waiting = [], 0, []
        if self.bundle.size >= self.bundle_bytes:
            self.bundle.close()
            self.bundle = None

    def close(self) -> None:
        if self.frame:
            self.flush()
        if self.bundle is not None:
            self.bundle.close()
            self.bundle = None

    def finished(self) -> Iterator[pa.RecordBatch]:
        if self.done:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4]
            names = [c.split()[0] for c in INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.done, strict=True), kinds,
                                                                             strict=True)], names)
            self.done = []


def read(index: DataFrame) -> DataFrame:
    """Read every indexed record back from its bundle.

    Rows: page_id, payload_bytes, payload_digest, record_type, refers_to.  The
    digest of a response is computed from the block that was read and must
    equal the header; a revisit's size and digest come from its headers.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, frame, unzip = None, b"", zstandard.ZstdDecompressor()
        tables: dict[str, list] = {}
        for batch in batches:
            out = []
            for path, number, offset, length in zip(*(batch.column(c).to_pylist() for c in
                                                      ("bundle", "frame", "record_offset", "record_bytes")),
                                                    strict=True):
                if at != (path, number):
                    if path not in tables:
                        tables = {path: seek_table(path)}
                    start, packed, plain = tables[path][number]
                    store, inner = open_store(path)
                    with store.open_input_file(inner) as f:
                        f.seek(start)
                        frame = unzip.decompress(f.read(packed), max_output_size=plain)
                    at = path, number
                fields, block = parse(frame[offset:offset + length])
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                size = int(fields["warc-payload-length"])
                if kind == "response" and (len(block) != size or hashlib.sha256(block).hexdigest() != digest):
                    raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
                number_of = lambda x: int(x[len("<urn:page:"):-1]) if x and x != "<urn:page:>" else None
                out.append((number_of(fields["warc-record-id"]), size, digest, kind,
                            number_of(fields.get("warc-refers-to"))))
            if out:
                cols = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                                 ["page_id", "payload_bytes", "payload_digest", "record_type",
                                                  "refers_to"])

    by_frame = index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "record_offset")
    return by_frame.mapInArrow(run, RESULT)


def lookup(index: DataFrame, page_ids: list[int]) -> DataFrame:
    """Only the named pages, each by one seek."""
    return read(index.where(F.col("page_id").isin(page_ids)))


def op5_seekable_warc(spark, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "pages"), scratch_path(spark, "warc")))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::bigint AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
