"""WARC archives as seekable Zstandard bundles.

Each task writes the records of its rows into bundles in the shared folder: records are grouped into
independent frames of about ``FRAME_BYTES``, a bundle ends with a seek table in a skippable frame (the
published seekable format), and a new bundle begins after ``BUNDLE_BYTES``.  The index, written through
Spark's commit, has for each record its bundle, frame and offset within the frame; bundles of lost task
attempts are not in it and so are never read.  A record is fetched by reading the seek table and one
frame.

Of records with equal payloads of at least 100 bytes, that with the smallest id is the response and the
others are revisits of it.  Defined results: a null payload is empty; rows with the smallest id are all
responses; a row without an id is a revisit where a row with an id has its payload, else a response;
null URLs are left out of the record; a payload longer than a frame has a frame of its own; an empty table has
no bundles and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from .common import col, lookup, new_path, settle, slices, table

LEAST_SHARED = 100
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
TASK_FRAMES = 32  # frames that a task reads
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

INDEX = (
    StructType().add("record_id", StringType()).add("page_id", LongType()).add("bundle", StringType())
    .add("frame", IntegerType()).add("offset", LongType()).add("length", LongType()).add("record_type", StringType())
)


def open_store(path: str) -> tuple[Any, str]:
    """The file system of a path or URI of the shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(record_id: str, kind: str, url: str | None, page_id: int | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page: {refers_to}")
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """Header, payload length and payload of each record of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        begin, size = end + 4, int(head["Content-Length"])
        http, _, payload = data[begin : begin + size].partition(b"\r\n\r\n")
        length = int(http.rsplit(b"Content-Length: ", 1)[1])
        yield head, length, payload
        at = begin + size + 4


class BundleWriter:
    """A seekable bundle: frames of records and the seek table at its end."""

    def __init__(self, folder: str, task: int) -> None:
        import zstandard

        self.zstd = zstandard.ZstdCompressor(level=3)
        self.path = f"{folder}/bundle-{task:06d}-{uuid.uuid4().hex}.warc.zst"
        store, path = open_store(self.path)
        self.out = store.open_output_stream(path, compression=None)
        self.frames: list[tuple[int, int]] = []
        self.pending: list[bytes] = []
        self.size = self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset within the frame."""
        if self.size and self.size + len(data) > FRAME_BYTES:
            self.flush()
        place = len(self.frames), self.size
        self.pending.append(data)
        self.size += len(data)
        return place

    def flush(self) -> None:
        if self.size:
            packed = self.zstd.compress(b"".join(self.pending))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.pending, self.size = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames), 0, SEEKABLE))
        self.out.close()


class BundleReader:
    """Frames of a bundle by number, found with its seek table."""

    def __init__(self, path: str) -> None:
        import zstandard

        self.zstd = zstandard.ZstdDecompressor()
        store, inner = open_store(path)
        self.file = store.open_input_file(inner)
        size = self.file.size()
        self.file.seek(size - 9)
        frames, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        self.file.seek(size - 9 - 8 * frames)
        entries = list(struct.iter_unpack("<II", self.file.read(8 * frames)))
        self.frames = []
        at = 0
        for packed, plain in entries:
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        self.file.seek(at)
        return self.zstd.decompress(self.file.read(packed), max_output_size=plain)

    def close(self) -> None:
        self.file.close()


def with_types(pages: DataFrame, id_: str, url: str, payload: Column) -> DataFrame:
    """_id, _url, _payload, _digest and the id a revisit refers to (null for a response)."""
    text = F.coalesce(payload, F.lit(""))
    rows = pages.select(
        col(id_).cast("long").alias("_id"), col(url).alias("_url"), text.alias("_payload"),
        F.sha2(text.cast("binary"), 256).alias("_digest"), F.octet_length(text).alias("_bytes"),
    )
    shared = rows.where(F.col("_bytes") >= LEAST_SHARED).groupBy(F.col("_digest").alias("_same"))
    first = settle(shared.agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "payloads")
    out = lookup(rows, first.drop("_n"), F.col("_digest") == F.col("_same"))
    refers = F.when(F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return out.select("_id", "_url", "_payload", "_digest", refers.alias("_refers_to"))


def write_bundles(pages: DataFrame, id_: str, url: str, payload: str) -> DataFrame:
    """Write the archives into the shared folder and return their index."""
    folder = new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        writer = None
        for batch in batches:
            for part in slices(batch):
                rows = []
                for page_id, target, text, digest, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if writer is None:
                        open_store(folder)[0].create_dir(open_store(folder)[1], recursive=True)
                        writer = BundleWriter(folder, task)
                    kind = "response" if refers_to is None else "revisit"
                    record_id = str(uuid.uuid4())
                    data = record(record_id, kind, target, page_id, text.encode("utf-8"), digest, refers_to)
                    frame, offset = writer.add(data)
                    rows.append((record_id, page_id, writer.path, frame, offset, len(data), kind))
                    if writer.written >= BUNDLE_BYTES:
                        writer.close()
                        writer = None
                columns = list(zip(*rows, strict=True))
                types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], INDEX.names)
        if writer is not None:
            writer.close()

    return settle(with_types(pages, id_, url, col(payload)).mapInArrow(run, INDEX), "warc-index")


def read_bundles(index: DataFrame) -> DataFrame:
    """All records of the bundles in an index: id, URL, type, payload and what the headers say."""
    schema = (
        StructType().add("page_id", LongType()).add("url", StringType()).add("record_type", StringType())
        .add("payload", StringType()).add("payload_bytes", LongType()).add("payload_digest", StringType())
        .add("computed_digest", StringType()).add("refers_to", LongType())
    )
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    frames = index.groupBy("bundle", "frame").agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, reader = None, None
        for batch in batches:
            for bundle, frame, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != path:
                    if reader:
                        reader.close()
                    path, reader = bundle, BundleReader(bundle)
                rows = []
                for head, length, payload in parse(reader.frame(frame)):
                    response = head["WARC-Type"] == "response"
                    rows.append((
                        int(head["X-Page"]) if "X-Page" in head else None, head.get("WARC-Target-URI"), head["WARC-Type"],
                        payload.decode("utf-8") if response else None, length, head["WARC-Payload-Digest"].removeprefix("sha256:"),
                        hashlib.sha256(payload).hexdigest() if response else None,
                        None if response else int(head["X-Refers-To-Page"]),
                    ))
                if len(rows) != n:
                    raise ValueError(f"{bundle}, frame {frame}: {len(rows)} records, the index has {n}")
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)
        if reader:
            reader.close()

    tasks = -(-frames.count() // TASK_FRAMES)
    stretch = F.floor(F.col("frame") / TASK_FRAMES)
    return frames.repartition(max(1, tasks), "bundle", stretch).sortWithinPartitions("bundle", "frame").mapInArrow(run, schema)


def fetch(index: DataFrame, wanted: Column) -> DataFrame:
    """page_id, record_id and the whole record of index rows, each by one frame read and its offset."""
    schema = StructType().add("page_id", LongType()).add("record_id", StringType()).add("record", StringType())
    rows = index.where(wanted).select("page_id", "record_id", "bundle", "frame", "offset", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, record_id, bundle, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = BundleReader(bundle)
                text = reader.frame(frame)[offset : offset + length].decode("utf-8")
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array([page_id], pa.int64()), pa.array([record_id]), pa.array([text])], schema.names)

    return rows.sortWithinPartitions("bundle", "frame").mapInArrow(run, schema)


def op5(spark: SparkSession, folder: str) -> DataFrame:
    index = write_bundles(table(spark, folder, "pages"), "page_id", "url", "html")
    read = read_bundles(index)
    digest = F.coalesce("computed_digest", "payload_digest")
    return read.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


SQL = f"""
with p as (
  select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, cast(octet_length(b) as bigint) as payload_bytes, sha256(b) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= {LEAST_SHARED} group by 1)
select page_id, payload_bytes, payload_digest,
  case when first is null or first is not distinct from page_id then 'response' else 'revisit' end as record_type,
  case when first is not null and first is distinct from page_id then first end as refers_to
from d left join f using (payload_digest)
"""
