"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames, and a bundle ends with the seek table of the public seekable
format (a skippable frame that lists each frame's sizes).  The index maps a record's identifier to its bundle, its
frame and its offset in that frame's plain bytes, so a record is read by one seek and one small decompression.

Equal payloads (by SHA-1 and length) of at least ``min_revisit_bytes`` share a record: that of the largest page_id is
a response and the others revisit it.  Sums by payload are made before the shuffle; a payload that many pages share is
a skewed join key, which adaptive execution splits.  A task streams its records into files below the shared folder,
holding one frame in memory; only files that the committed index names count, so a task that is run again after a
lost executor leaves at most a file that nothing reads.

The bundles go to the folder of spark.checkpoint.dir by pyarrow's file systems: file, hdfs (with libhdfs), s3 and gs folders
work, and folders of Spark that pyarrow has no file system for do not.

Defined results: null html is an empty payload; a null url is written empty; of rows that repeat the winning page_id
with the same payload each is a response; a null page_id never wins, and where all of a payload's page_ids are null,
all its rows are responses; an empty table gives no bundle and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvello.llm.common import bound_batches, materialise, shared_dir

# Fixed values of the seekable Zstandard format and of WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit (refers_to is given) has the HTTP head but no payload."""
    revisit = refers_to is not None
    block = HTTP_HEAD.format(len(payload)).encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or ""),
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(plain: bytes, at: int) -> tuple[dict[str, str], int, bytes, int]:
    """Headers, payload length by the HTTP head, payload, and where the next record begins."""
    end = plain.index(b"\r\n\r\n", at)
    lines = plain[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(": "), "") for x in lines[1:])
    block = plain[end + 4 : (after := end + 4 + int(head["Content-Length"]))]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    return head, length, payload, after + 4


class BundleWriter:
    """Writes one bundle and keeps where each record went."""

    def __init__(self, fs: pafs.FileSystem, path: str, level: int = 3) -> None:
        self.path, self.out, self.codec = path, fs.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=level)
        self.frame, self.sizes, self.bytes, self.index = io.BytesIO(), [], 0, []

    def add(self, page_id, record: bytes) -> None:
        if self.frame.tell() and self.frame.tell() + len(record) > FRAME_BYTES:
            self.flush()
        self.index.append((page_id, len(self.sizes), self.frame.tell(), len(record)))
        self.frame.write(record)

    def flush(self) -> None:
        if plain := self.frame.getvalue():
            packed = self.codec.compress(plain)
            self.out.write(packed)
            self.sizes.append((len(packed), len(plain)))
            self.bytes += len(packed)
            self.frame = io.BytesIO()

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.out.close()


class BundleReader:
    """Random access to a bundle's frames by its seek table."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(8 * n, size - 9 - 8 * n)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], int, bytes, int]:
        return parse_record(self.frame(frame), offset)


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def typed(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 and refers_to (null for responses) of every page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n"))
    shared = rows.groupBy("sha1", "n").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("copies"))
    shared = shared.where((F.col("copies") > 1) & (F.col("n") >= min_revisit_bytes)).drop("copies")
    revisit = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return rows.join(shared, ["sha1", "n"], "left").select("page_id", "url", "payload", F.when(revisit, F.col("winner")).alias("refers_to"))


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages into bundles below the shared folder.

    Returns the committed index: record_id, page_id, bundle, frame, offset (in the frame's plain bytes) and length.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    bound_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        bundle = None

        def closed() -> pa.RecordBatch:
            bundle.close()
            ids, frames, offsets, lengths = map(list, zip(*bundle.index, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([f"urn:page:{x}" for x in ids]), pa.array(ids, pa.int64()), pa.array([f"{folder}/{bundle.path.rpartition('/')[2]}"] * len(ids)), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["record_id", "page_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    fs.create_dir(base, recursive=True)
                    bundle = BundleWriter(fs, f"{base}/{uuid.uuid4().hex}.warc.zst")
                bundle.add(page_id, record_bytes(page_id, url, payload, base32_digest(payload), refers_to))
                if bundle.bytes > BUNDLE_BYTES:
                    yield closed()
                    bundle = None
        if bundle is not None:
            yield closed()

    index = typed(pages, min_revisit_bytes).mapInArrow(write, "record_id string, page_id long, bundle string, frame int, offset long, length long")
    return materialise(index, "warc-index")


def read_archives(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Every record of the bundles that the index names; a response's payload is held against its digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                reader = BundleReader(*pafs.FileSystem.from_uri(uri))
                for k in range(len(reader.frames)):
                    plain, at, rows = reader.frame(k), 0, []
                    while at < len(plain):
                        head, length, payload, at = parse_record(plain, at)
                        page, digest, kind = head["WARC-Record-ID"][10:-1], head["WARC-Payload-Digest"][5:], head["WARC-Type"]
                        if kind == "response" and (len(payload) != length or base32_digest(payload) != digest):
                            raise ValueError(f"{uri}: page {page} is damaged")
                        refers = head.get("WARC-Refers-To", "")[10:-1]
                        rows.append((None if page == "None" else int(page), length, digest, kind, int(refers) if refers else None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    bundles = index.select("bundle").distinct()
    bundles = bundles.repartition(max(1, min(bundles.count(), 10_000)))
    return bundles.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
