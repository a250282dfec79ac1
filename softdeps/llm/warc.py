"""WARC archives as seekable Zstandard bundles.

A record is written for every page; a payload that an earlier page (by id) has as well becomes a revisit record without payload.  A task groups its records
into frames of about a megabyte, compresses each on its own, and closes a bundle with a seek table in a skippable frame, so that a decoder that knows
nothing of it reads the bundle as one WARC file.  The seek table gives every frame's compressed and plain size and checksum; an index maps a record's
identifier to its bundle, frame and place in the frame, so that one record costs one frame.

Bundles are the rows of a table with a binary column, as only Spark's writers reach every store; ``save_bundles`` writes them as files where a folder is
mounted on all machines.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softdeps.llm.common import map_batches, stage

# Fixed values of the seekable format: a skippable frame's magic number, the seek table's, and its descriptor (entries with checksums).
SKIPPABLE, SEEKABLE, DESCRIPTOR = 0x184D2A5E, 0x8F92EAB1, 0x80

# Plain bytes of a frame and compressed bytes of a bundle at which a new one is begun; one record is never cut.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 8 << 20

# Payloads with more than one part in so many of all copies are broadcast.
HOT_SHARE = 1000

# Payloads below so many bytes are never told as copies.
REVISIT_BYTES = 100

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BUNDLE = "bundle string, content binary"
RECORD = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'-' if page_id is None else page_id}>"


def page_of(rid: str) -> int | None:
    name = rid.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "-" else int(name)


def one_line(url: str) -> bytes:
    """A URL fit for a header line: line ends are percent-encoded, as no URL may hold them."""
    return url.replace("\r", "%0D").replace("\n", "%0A").encode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    """One record; a revisit keeps the response's HTTP head, whose length is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + record_id(page_id).encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        *([b"WARC-Target-URI: " + one_line(url)] if url is not None else []),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        *([b"WARC-Refers-To: " + record_id(refers_to).encode(), b"WARC-Profile: " + PROFILE.encode()] if revisit else []),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """The closing frame for frames of ``(compressed bytes, plain bytes, checksum)``."""
    body = b"".join(struct.pack("<III", *f) for f in frames) + struct.pack("<IBI", len(frames), DESCRIPTOR, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(content: bytes) -> list[tuple[int, int, int, int]]:
    """``(place in the bundle, compressed bytes, plain bytes, checksum)`` of every frame, from the bundle's end."""
    count, descriptor, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE or descriptor != DESCRIPTOR:
        raise ValueError("not a seekable bundle with checksums")
    at, out = 0, []
    for entry in struct.iter_unpack("<III", content[-9 - 12 * count : -9]):
        out.append((at, *entry))
        at += entry[0]
    return out


def frame(content: bytes, entry: tuple[int, int, int, int]) -> bytes:
    """A frame's plain bytes, checked."""
    at, size, plain, check = entry
    found = zstandard.ZstdDecompressor().decompress(content[at : at + size], max_output_size=plain)
    if len(found) != plain or xxhash.xxh64_intdigest(found) & 0xFFFFFFFF != check:
        raise ValueError("a frame's bytes don't match its checksum")
    return found


def parse_record(data: bytes, at: int) -> tuple[dict[bytes, bytes], bytes, int]:
    """Header fields, block and end of the record at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].split(b"\r\n")
    if version != b"WARC/1.1":
        raise ValueError("no record begins here")
    head = dict(line.split(b": ", 1) for line in lines)
    start = end + 4
    stop = start + int(head[b"Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return head, data[start:stop], stop + 4


def read_record(head: dict[bytes, bytes], block: bytes) -> tuple:
    """A row of ``RECORD``."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
    kind, rid = head[b"WARC-Type"].decode(), head[b"WARC-Record-ID"].decode()
    refers = page_of(head[b"WARC-Refers-To"].decode()) if kind == "revisit" else None
    url = head.get(b"WARC-Target-URI")
    digest = head[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
    return rid, page_of(rid), None if url is None else url.decode(), kind, refers, size, digest, payload if kind == "response" else None


class Bundler:
    """Collects records into frames and frames into a bundle."""

    def __init__(self, frame_bytes: int, level: int) -> None:
        self.frame_bytes, self.compress = frame_bytes, zstandard.ZstdCompressor(level=level).compress
        self.clear()

    def clear(self) -> None:
        self.name, self.plain, self.content, self.frames = uuid.uuid4().hex, bytearray(), bytearray(), []

    def add(self, record: bytes) -> tuple[int, int]:
        """The record's frame and its place in it."""
        if self.plain and len(self.plain) + len(record) > self.frame_bytes:
            self.end_frame()
        place = len(self.frames), len(self.plain)
        self.plain += record
        return place

    def end_frame(self) -> None:
        plain = bytes(self.plain)
        packed = self.compress(plain)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.content += packed
        self.plain = bytearray()

    def end(self) -> bytes:
        if self.plain:
            self.end_frame()
        return bytes(self.content) + seek_table(self.frames)


def told_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``(page_id, url, html, payload_bytes, payload_digest, revisit, refers_to)``; ``html`` is null for revisits.

    Only digests that occur twice or more are joined back.  Those with more than a thousandth of all copies, fewer than a thousand, are broadcast, so that a
    page that a third of the table copies is no key of a shuffle; every other key has at most that thousandth of rows.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    size, digest = F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("payload_digest")
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", size, digest)
    told = rows.where(F.col("payload_bytes") >= revisit_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    copied = stage(told.where("n > 1"), "copied")
    limit = (copied.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    named = lambda kind: copied.where(f"n {kind} {limit}").select("payload_digest", "first", F.lit(True).alias("is"))
    copy_of_hot = F.col("hot.is").isNotNull() & ~F.col("r.page_id").eqNullSafe(F.col("hot.first"))
    kept = [c for c in rows.columns if c != "html"]
    first = rows.alias("r").join(F.broadcast(named(">")).alias("hot"), F.col("r.payload_digest") == F.col("hot.payload_digest"), "left")
    first = first.select(*(f"r.{c}" for c in kept), F.when(~copy_of_hot, F.col("html")).alias("html"), copy_of_hot.alias("again"), F.col("hot.first").alias("hot"))
    copy = F.col("o.is").isNotNull() & ~F.col("r.page_id").eqNullSafe(F.col("o.first"))
    both = first.alias("r").join(named("<=").alias("o"), F.col("r.payload_digest") == F.col("o.payload_digest"), "left")
    refers = F.when(F.col("again"), F.col("hot")).when(copy, F.col("o.first")).alias("refers_to")
    return both.select(*(f"r.{c}" for c in kept), F.when(~copy, F.col("html")).alias("html"), (F.col("again") | copy).alias("revisit"), refers)


def write_bundles(pages: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3) -> DataFrame:
    """A staged table ``(bundle, content, entries)``: archives and the places ``(record_id, frame, offset, length)`` of their records.

    ``pages(page_id, url, html)``.  A null html is an empty payload, a null url writes no target.  Of equal payloads of at least ``REVISIT_BYTES`` the rows with
    the smallest id (all, if they share it) are responses and the others revisits of it; a null id is never the smallest unless all are null.
    Shared ids share a record identifier.  An empty table gives no bundles.  Further columns are left out.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, entries = Bundler(frame_bytes, level), []

        def closed() -> pa.RecordBatch:
            content, name, places = bundler.end(), bundler.name, list(entries)
            bundler.clear()
            entries.clear()
            kinds = [pa.string(), pa.binary(), pa.list_(pa.struct({"record_id": pa.string(), "frame": pa.int32(), "offset": pa.int64(), "length": pa.int64()}))]
            values = ([name], [content], [places])
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["bundle", "content", "entries"])

        for batch in batches:
            columns = [c.cast(pa.binary()) if n == "html" else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
            for page_id, url, html, size, digest, revisit, refers in zip(*(c.to_pylist() for c in columns), strict=True):
                record = warc_record(page_id, url, html or b"", size, digest, revisit, refers)
                at, offset = bundler.add(record)
                entries.append({"record_id": record_id(page_id), "frame": at, "offset": offset, "length": len(record)})
                if len(bundler.content) >= bundle_bytes:
                    yield closed()
        if entries:
            yield closed()

    told = told_records(pages).select("page_id", "url", "html", "payload_bytes", "payload_digest", "revisit", "refers_to")
    return stage(map_batches(told, task, BUNDLE + ", entries array<struct<record_id:string,frame:int,offset:long,length:long>>"), "bundles")


def record_index(bundles: DataFrame) -> DataFrame:
    """``(record_id, bundle, frame, offset, length)``: where each record begins inside its frame's plain bytes."""
    return bundles.select("bundle", F.explode("entries").alias("e")).select("e.record_id", "bundle", "e.frame", "e.offset", "e.length")


def _rows(found: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [f.split(" ")[0] for f in RECORD.split(", ")]
    values = list(zip(*found, strict=True)) or [()] * len(kinds)
    if not with_payload:
        values[-1] = (None,) * len(found)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)


def _checked(row: tuple) -> tuple:
    payload = row[7]
    if payload is not None and (len(payload) != row[5] or hashlib.sha256(payload).hexdigest() != row[6]):
        raise ValueError(f"the payload of {row[0]} doesn't match its digest")
    return row


def read_bundles(bundles: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of ``bundles(content)``, as ``RECORD`` says: frames by the seek table, checksums and payload digests checked.

    Size and digest of a revisit are those of the payload it refers to; its own payload is null.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                whole = content.as_py()
                for entry in read_seek_table(whole):
                    plain, at, found = frame(whole, entry), 0, []
                    while at < len(plain):
                        head, block, at = parse_record(plain, at)
                        found.append(_checked(read_record(head, block)))
                    yield _rows(found, with_payload)

    return map_batches(bundles.select("content"), task, RECORD)


def fetch_records(bundles: DataFrame, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of ``wanted(record_id)``: each needed frame is decompressed once and the record read at its place."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, places in zip(batch.column(0), batch.column(1), strict=True):
                whole, last, plain = content.as_py(), None, b""
                table, found = read_seek_table(whole), []
                for place in sorted(places.as_py(), key=lambda p: (p["frame"], p["offset"])):
                    if place["frame"] != last:
                        last, plain = place["frame"], frame(whole, table[place["frame"]])
                    head, block, _ = parse_record(plain, place["offset"])
                    found.append(_checked(read_record(head, block)))
                yield _rows(found, True)

    places = F.collect_list(F.struct("frame", "offset")).alias("places")  # at most the records of one bundle
    named = index.join(wanted.select("record_id").distinct(), "record_id", "left_semi").groupBy("bundle").agg(places)
    return map_batches(bundles.join(named, "bundle").select("content", "places"), task, RECORD)


def save_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle as ``<bundle>.warc.zst`` into a folder that is mounted on every machine; ``(bundle, path, bytes)``.

    A file is written under another name and renamed, so that a task that runs twice leaves no half file.  ``binaryFile`` reads the folder back.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path, whole = f"{folder}/{name}.warc.zst", content.as_py()
                part = f"{path}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as out:
                    out.write(whole)
                os.replace(part, path)
                done.append((name, path, len(whole)))
            values = list(zip(*done, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["bundle", "path", "bytes"])

    return stage(map_batches(bundles.select("bundle", "content"), task, "bundle string, path string, bytes long"), "saved")
