"""WARC: records in seekable Zstandard bundles, found again by an index of frame-relative offsets."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hot_join

#: Fixed values of the Zstandard seekable format: magic of the skippable frame and of its footer.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Bytes of records that a reading task is meant to take.
TASK_BYTES = 64 << 20
MANIFEST = "page_id long, record_id string, bundle string, frame int, offset long, length long"


def record_id(bundle: uuid.UUID, number: int) -> str:
    """A name of its own for each record, whatever page_ids repeat: a function of the bundle and its place there."""
    return f"urn:uuid:{uuid.uuid5(bundle, str(number))}"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(name: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: a response, or a revisit whose HTTP header keeps the length of the payload left out.

    Page-ID and Refers-To-Page-ID are fields of our own beside the standard ones: pages are found by number, records by name.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest32(payload)}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Writes records to one file: a frame ends once it holds ``frame_bytes``, the seek table follows the last frame."""

    def __init__(self, out, frame_bytes: int = 1 << 18, level: int = 3):
        self.out, self.frame_bytes, self.zstd = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.filled, self.written = 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset in the frame's content) of the record."""
        if self.filled and self.filled + len(data) > self.frame_bytes:
            self._end_frame()
        place = len(self.frames), self.filled
        self.open.append(data)
        self.filled += len(data)
        return place

    def _end_frame(self) -> None:
        packed = self.zstd.compress(b"".join(self.open))
        self.out.write(packed)
        self.frames.append((len(packed), self.filled))
        self.written += len(packed)
        self.open, self.filled = [], 0

    def close(self) -> None:
        if self.filled:
            self._end_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access: reads the footer and the seek table, then single frames."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end of the bundle")
        source.seek(size - 9 - 8 * n)
        sizes = list(struct.iter_unpack("<II", source.read(8 * n)))
        self.starts, at = [], 0
        for packed, plain in sizes:
            self.starts.append((at, packed, plain))
            at += packed
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.starts[i]
        self.source.seek(at)
        return self.zstd.decompress(self.source.read(packed), max_output_size=plain)

    def frames(self) -> Iterator[bytes]:
        return map(self.frame, range(len(self.starts)))

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def parse(data: bytes, at: int = 0) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records in a frame's content."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _writer(root: str, bundle_bytes: int, frame_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        writer, name, path, rows, number = None, uuid.UUID(int=0), "", [], 0

        def flush() -> pa.RecordBatch:
            nonlocal rows
            cols, rows = list(zip(*rows)), []
            types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["page_id", "record_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            for page_id, url, html, keeper in zip(*(batch.column(c) for c in ("page_id", "url", "html", "keeper"))):
                page, keep, payload = page_id.as_py(), keeper.as_py(), (html.as_py() or "").encode()
                if writer is None:  # a name of its own for each attempt: a repeated task never touches a file in the manifest
                    name, number = uuid.uuid4(), 0
                    path = f"{folder}/{name.hex}.warc.zst"
                    writer = BundleWriter(store.open_output_stream(path, compression=None), frame_bytes)
                own = record_id(name, number)
                data = record(own, page, url.as_py(), payload, keep, keep is not None and keep != page)
                rows.append((page, own, path, *writer.add(data), len(data)))
                number += 1
                if writer.written > bundle_bytes:
                    writer.close()
                    writer = None
                    yield flush()
        if writer is not None:
            writer.close()
            yield flush()

    return run


def _reader(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        path = reader = source = frame = content = None
        for batch in batches:
            rows = []
            for bundle, number, offset, length, name in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length", "record_id"))):
                if bundle != path:
                    if source is not None:
                        source.close()
                    source = store.open_input_file(bundle)
                    path, reader, frame = bundle, BundleReader(source), None
                if number != frame:
                    frame, content = number, reader.frame(number)
                head, block = next(parse(content[offset : offset + length]))
                if head["WARC-Record-ID"] != f"<{name}>":
                    raise ValueError(f"the manifest's {name} is not in its place")
                rows.append(_row(head, block))
                if len(rows) == 1000:
                    yield _read_batch(rows)
                    rows = []
            yield _read_batch(rows)
        if source is not None:
            source.close()

    return run


_READ = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(_READ)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], names=_READ)


def _row(head: dict[str, str], block: bytes) -> tuple:
    number = lambda field: int(head[field]) if field in head else None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest32(payload) != digest):
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    return number("Page-ID"), size, digest, kind, number("Refers-To-Page-ID"), payload.decode() if kind == "response" else None


def write_warc(pages: DataFrame, scratch: Scratch, min_bytes: int = 0, bundle_bytes: int = 64 << 20, frame_bytes: int = 1 << 18) -> tuple[DataFrame, str]:
    """(manifest, folder): one record per row of ``pages(page_id, url, html)`` and where to find it.

    Of rows with equal payloads of ``min_bytes`` bytes or more, that with the largest page_id is the response and the others
    revisit it; smaller payloads are all responses. A null html is an empty payload. Rows that share the largest page_id are all
    responses; record ids tell them apart; a null page_id revisits any other and is a response among its like. A null url leaves out the target.

    Tasks stream records to files of their own in the shared folder and report them in the manifest, which is
    written at once; files of failed attempts are in no manifest.
    """
    html = F.coalesce("html", F.lit(""))
    hashed = pages.select("page_id", "url", html.alias("html"), F.when(F.octet_length(html) >= min_bytes, F.unhex(F.sha1(html.cast("binary")))).alias("sha"))
    groups = scratch.stage(hashed.where("sha IS NOT NULL").groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("keeper")), "payloads")
    total = groups.agg(F.sum("n")).head()[0] or 0
    root = scratch.path("bundles")
    placed = hot_join(hashed, groups, ["sha"], "n", total, ["keeper"], ["page_id"]).select("page_id", "url", "html", "keeper")
    return scratch.stage(placed.mapInArrow(_writer(root, bundle_bytes, frame_bytes), MANIFEST), "manifest"), root


def read_warc(manifest: DataFrame, root: str, frames_per_task: int = 64) -> DataFrame:
    """The records of the manifest: (page_id, payload_bytes, payload_digest, record_type, refers_to, html).

    Each record is read at its bundle, frame and offset. Stretches of neighbouring frames of a bundle are dealt out over the
    tasks, sorted, so a task reads a frame once and no bundle waits for another. Names, digests and lengths are
    checked while reading; html is null for revisits.
    """
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = manifest.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]
    places = manifest.select("bundle", "frame", "offset", "length", "record_id").repartition(max(tasks, held // TASK_BYTES), "bundle", F.floor(F.col("frame") / frames_per_task))
    return places.sortWithinPartitions("bundle", "frame", "offset").mapInArrow(_reader(root), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def read_record(root: str, bundle: str, frame: int, offset: int, length: int) -> bytes:
    """One record by its place in the manifest; decompresses a single frame."""
    store, _ = fs.FileSystem.from_uri(root)
    with store.open_input_file(bundle) as source:
        return BundleReader(source).record(frame, offset, length)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read_warc(*write_warc(pages, Scratch(spark, "warc"))).drop("html")


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS keeper FROM p)
SELECT page_id, payload_bytes,
       list_reduce([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
           (((('0x' || substr(h || '00', 1 + (i * 5) // 4, 3))::BIGINT) >> (7 - (i * 5) % 4)) & 31))::INT, 1) FOR i IN range(32)], lambda a, c: a || c) AS payload_digest,
       CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM q
"""
