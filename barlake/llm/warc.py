"""WARC bundles of independent Zstandard frames with a seek table, and their reader."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.shared import Scratch, binary_list, read_table, with_row_key

# Payloads from this size are stored once.
MIN_REVISIT = 1000
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
LEVEL = 6

# Fixed values of the public seekable format: skippable frame with the seek table, footer with the magic number.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

_CRLF = b"\r\n"
INDEX = "row_key bigint, page_id bigint, record_id string, bundle string, frame int, at bigint, length bigint"


def _record(page_id: int | None, record_id: str, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the headers of its response only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if url:
        head.append(f"WARC-Target-URI: {url}")
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{_record_id(refers_to)}>",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _CRLF * 2 + block + _CRLF * 2


def _record_id(page_id: int | None, row_key: int = 0) -> str:
    name = f"page {page_id}" if page_id is not None else f"row {row_key}"
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}"


class BundleWriter:
    """Frames go out as they fill; memory holds one frame. The file appears under its name when it is complete."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temporary)
        self.zip = zstd.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.buffer = bytearray()
        self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame number and offset in the frame's content."""
        if self.buffer and len(self.buffer) + len(record) > FRAME_BYTES:
            self._flush()
        place = len(self.frames), len(self.buffer)
        self.buffer += record
        return place

    def _flush(self) -> None:
        packed = self.zip.compress(bytes(self.buffer))
        self.out.write(packed)
        self.frames.append((len(packed), len(self.buffer)))
        self.written += len(packed)
        self.buffer.clear()

    def close(self) -> None:
        if self.buffer:
            self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack(
            "<IBI", len(self.frames), 0, SEEKABLE_MAGIC
        )
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        self.fs.move(self.temporary, self.path)


class BundleReader:
    """Random access by the seek table at the end of a bundle."""

    def __init__(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"no seek table in {uri}")
        width = 12 if flags & 0x80 else 8
        table = self.file.read_at(count * width, size - 9 - count * width)
        self.frames, at = [], 0
        for i in range(count):
            packed, plain = struct.unpack_from("<II", table, i * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        return zstd.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}


def parse_record(raw: bytes) -> dict:
    """Headers of a record and what they and its payload say."""
    head, _, rest = raw.partition(_CRLF * 2)
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(_CRLF * 2)
    revisit = fields["warc-type"] == "revisit"
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    digest = stated if revisit else hashlib.sha1(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"digest of {fields['warc-record-id']} does not match")
    refers = fields.get("x-refers-to-page-id")
    return {
        "page_id": int(fields["x-page-id"]) if fields["x-page-id"] else None,
        "payload": None if revisit else payload,
        "payload_bytes": int(_fields(http)["content-length"]),
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": int(refers) if refers else None,
    }


def decide(pages: DataFrame) -> DataFrame:
    """``row_key, refers_to``: the kept page of every row that revisits one. Payloads never leave their digest."""
    light = pages.select("row_key", "page_id", "digest", "size").where((F.col("size") >= MIN_REVISIT) & F.col("page_id").isNotNull())
    groups = light.groupBy("digest", "size").agg(F.max("page_id").alias("kept"), F.min("page_id").alias("least"))
    shared = groups.where("least < kept").drop("least")
    return (
        light.join(shared, ["digest", "size"]).where("page_id < kept").select("row_key", F.col("kept").alias("refers_to")).distinct()
    )


def payload_of(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes bundles below ``folder`` and returns the index: record, bundle, frame, offset and length in the frame.

    ``pages`` has ``page_id, url, html``. Equal payloads of at least 1000 bytes are stored once, with the largest
    page_id; rows with smaller ids revisit it. Null html is an empty payload, a null url leaves its header out. Rows
    with a null page_id, and repeated rows of the kept page, are responses of their own. A repeated task writes the
    same records in the same order under the same name. No rows give no bundles.
    """
    keyed = with_row_key(pages.select("page_id", "url", "html"), "page_id", "url", "html")
    digested = keyed.select(
        "row_key", "page_id", F.sha1(payload_of(F.col("html"))).alias("digest"), F.octet_length(payload_of(F.col("html"))).alias("size")
    )
    placed = keyed.join(decide(digested), "row_key", "left").sortWithinPartitions("row_key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("row_key", "page_id", "url", "refers_to")]
            for key, page_id, url, refers_to, html in zip(*columns, binary_list(batch.column("html")), strict=True):
                payload = html or b""
                if out is not None and out.written >= BUNDLE_BYTES:
                    out.close()
                    out, seq = None, seq + 1
                if out is None:
                    uri = f"{folder}/part-{part:06d}-{seq:04d}.warc.zst"
                    out = BundleWriter(uri)
                record_id = _record_id(page_id, key)
                safe = (url or "").replace("\r", "%0D").replace("\n", "%0A")
                record = _record(page_id, record_id, safe, payload, hashlib.sha1(payload).hexdigest(), refers_to)
                frame, at = out.add(record)
                rows.append((key, page_id, record_id, uri, frame, at, len(record)))
            if rows:
                names = ["row_key", "page_id", "record_id", "bundle", "frame", "at", "length"]
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        if out is not None:
            out.close()

    return placed.mapInArrow(run, INDEX)


def read(index: DataFrame) -> DataFrame:
    """Every record of the index from its bundle; a frame is decompressed once for all its records.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, payload``; the digest of a response is worked out
    from the payload and compared with its header.
    """
    frames = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list(F.struct("at", "length"))).alias("places"))
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_uri, reader = None, None
        for batch in batches:
            for uri, frame, places in zip(*[batch.column(c).to_pylist() for c in ("bundle", "frame", "places")], strict=True):
                if uri != open_uri:
                    open_uri, reader = uri, BundleReader(uri)
                content = reader.frame(frame)
                found = [parse_record(content[p["at"] : p["at"] + p["length"]]) for p in places]
                arrays = [pa.array([r[n] for r in found], t) for n, t in zip(names, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return frames.sortWithinPartitions("bundle", "frame").mapInArrow(run, schema)


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    fs, path = pafs.FileSystem.from_uri(scratch.path("bundles"))
    fs.create_dir(path)
    index = scratch.table(write(read_table(spark, sf_dir, "pages"), scratch.path("bundles")), "index")
    return read(index).drop("payload")


SQL = {
    "op7_warc_bundles": """
WITH p AS (
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
           sha1(coalesce(html, '')) AS payload_digest
    FROM pages
),
k AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes)
                   ELSE page_id END AS kept
    FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM k
"""
}
QUERIES = {"op7_warc_bundles": op7_warc_bundles}
