"""WARC archives as seekable Zstandard bundles.

A bundle is a series of independent Zstandard frames, each holding whole WARC records, and a skippable frame with the
seek table: per frame its compressed and decompressed size, then the number of frames, a descriptor byte and the magic
number of the seekable format. Beside the bundles an index table maps each record id to (bundle, frame, offset in frame,
length), so one record is read by decompressing one frame.

Payloads that occur more than once are written once: the record with the largest id is the response, the others are
revisits that carry its id and digest and no payload.

Defined results. Null payload: empty. Empty payloads are payloads like any other. Repeated ids are written as records of
their own, of which the one of the largest id may be more than one response. Pages without an id are archived like others under
`urn:page:null` and returned with a null id; they revisit an equal payload that has an id and are responses otherwise. Long
payloads make a frame of their own. Columns other than id, url and payload are not read. An empty table writes no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.session import scratch, settle

#: fixed values of the seekable format
SEEKABLE_MAGIC, SKIPPABLE_MAGIC = 0x8F92EAB1, 0x184D2A5E
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 32 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def classify(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """pages(key, url, payload) with digest (hex SHA-1) and _response: the largest key of equal payloads.

    The largest key per digest is a grouped maximum that combines map-side. A payload shared by very many pages makes
    one hot digest in the join back; it is an ordinary sort-merge join, whose large partitions AQE splits.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col("url"), F.lit("")).alias("_url"), body.alias("_body"), F.sha1(body).alias("_digest"))
    keys = pages.select(F.col(key).cast("long").alias("_key"), F.sha1(body).alias("_digest"), F.octet_length(body).alias("_n"))
    best = keys.filter(F.col("_n") >= min_bytes).groupBy("_digest").agg(F.max("_key").alias("_response"))
    return rows.join(best, "_digest", "left").withColumn("_response", F.coalesce("_response", "_key"))


def _record(key: int | None, url: str, body: bytes, digest: str, response: int | None) -> bytes:
    revisit = response != key
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if key is None else key}>",
        f"WARC-Target-URI: {''.join(url.split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(body)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{response}>"]
        body = b""
    head.append(f"Content-Length: {len(body)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


class BundleWriter:
    """Frames and seek table of one bundle, kept in memory up to BUNDLE_BYTES of input."""

    def __init__(self, level: int = 3):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.out, self.sizes, self.frame, self.places, self.total = [], [], bytearray(), [], 0

    def add(self, key: int | None, record: bytes) -> None:
        if self.frame and len(self.frame) + len(record) > FRAME_BYTES:
            self.flush()
        self.places.append((key, len(self.sizes), len(self.frame), len(record)))
        self.frame += record
        self.total += len(record)

    def flush(self) -> None:
        if self.frame:
            packed = self.compress(bytes(self.frame))
            self.sizes.append((len(packed), len(self.frame)))
            self.out.append(packed)
            self.frame = bytearray()

    def finish(self) -> bytes:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.out) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed size, decompressed size) of each frame."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, out = 0, []
    start = len(bundle) - 9 - width * n
    for k in range(n):
        packed, plain = struct.unpack_from("<II", bundle, start + width * k)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(bundle: bytes, frame: tuple[int, int, int]) -> bytes:
    import zstandard

    at, packed, plain = frame
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=plain)


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of a decompressed frame."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:stop].decode().split("\r\n")[1:])
        body = stop + 4
        end = body + int(head["Content-Length"])
        yield at, head, data[body:end]
        at = end + 4


def _page(urn: str) -> int | None:
    """The page id in a record id; null for pages without one."""
    return None if urn == "<urn:page:null>" else int(urn[10:-1])


_INDEX = pa.schema([("key", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
INDEX_SCHEMA = "key long, bundle string, frame int, offset long, length long"


def _put(folder: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}", compression=None) as f:
        f.write(data)


def write_bundles(classified: DataFrame, folder: str) -> DataFrame:
    """Write bundles into folder and return the settled index. A task holds one bundle at a time.

    A bundle's name has the task's attempt in it: a task that runs again writes other files, and only those of the
    attempt whose index rows were committed are ever looked up.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        prefix = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        number, writer = 0, BundleWriter()

        def close() -> pa.RecordBatch:
            name = f"{prefix}-{number:04d}.warc.zst"
            places = writer.places
            _put(folder, name, writer.finish())
            keys, frames, offsets, lengths = (list(x) for x in zip(*places, strict=True))
            return pa.record_batch([pa.array(keys, pa.int64()), pa.array([name] * len(keys)), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], schema=_INDEX)

        for b in batches:
            for key, url, body, response in zip(*(b.column(c) for c in ("_key", "_url", "_body", "_response")), strict=True):
                payload = body.as_py().encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                writer.add(key.as_py(), _record(key.as_py(), url.as_py(), payload, digest, response.as_py()))
                if writer.total >= BUNDLE_BYTES:
                    yield close()
                    number, writer = number + 1, BundleWriter()
        if writer.places:
            yield close()

    return settle(classified.select("_key", "_url", "_body", "_response").mapInArrow(write, INDEX_SCHEMA), "warc-index")


_READ = pa.schema(
    [("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("key", pa.int64()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())]
)
READ_SCHEMA = "bundle string, frame int, offset long, key long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of every bundle; intact: a response's payload has the digest and length its header states."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                name, bundle = path.as_py().rsplit("/", 1)[1], content.as_py()
                for k, frame in enumerate(seek_table(bundle)):
                    rows = []
                    for offset, head, block in parse_records(read_frame(bundle, frame)):
                        kind = head["WARC-Type"]
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        refers = head.get("WARC-Refers-To")
                        size = int(head["X-Payload-Length"])
                        intact = kind == "revisit" or (len(block) == size and base64.b32encode(hashlib.sha1(block).digest()).decode() == digest)
                        rows.append((name, k, offset, _page(head["WARC-Record-ID"]), size, digest, kind, _page(refers) if refers else None, intact))
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("path", "content").mapInArrow(read, READ_SCHEMA)


def archive_pages(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write every page as a WARC record, read the archives back and return one row per indexed record."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    index = write_bundles(classify(pages, key, payload, min_bytes), folder)
    if index.isEmpty():
        return spark.createDataFrame([], f"{key} long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, offset long, intact boolean")
    found = read_bundles(spark, folder)
    at = ["bundle", "frame", "offset"]
    return index.select("key", *at).join(found.drop("key"), at, "left").select(
        F.col("key").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to", *at, "intact"
    )
