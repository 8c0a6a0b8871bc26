"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole WARC/1.1 records of about `frame_bytes`, closed by
the seek table of the public seekable format: a skippable frame with one entry (compressed size, decompressed size,
XXH64 checksum) per frame and a footer (number of frames, descriptor, magic number). A reader takes the footer from
the end of the file, finds a frame's place from the sums of the entries before it, and decompresses that frame alone.
The index maps a record's id to (bundle, frame, offset in the frame, length).

Of records with equal payloads the one with the largest id is written as response, and the others as revisits that
refer to it, without payload. Payloads of fewer than `min_dedup` bytes are always responses. Equality is decided on
(length, SHA-1, SHA-256) rows, which are small and pre-aggregated; payloads are then moved once, by record id and content, so a
payload shared by a third of all records lands in no single task and rows that share an id only keep their own roles.

Executors write bundles under names of their own attempt, and the index rows that Spark commits say which ones count: what
a lost or repeated attempt has left is in no index. Readers go by the index, so store it before reading. Defined results: null payload is empty; null url gives
no target URI; rows that repeat an id and a payload are all responses if the id is the largest.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelight.llm.common import materialize, small_side

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
BROADCAST_ROWS = 100_000
#: Fixed values of the seekable format: skippable frame magic, seek table magic, descriptor with checksums
SKIPPABLE, SEEKABLE, DESCRIPTOR = 0x184D2A5E, 0x8F92EAB1, 0x80
ID = "<urn:edgelight:record:{}>"
INDEX_SCHEMA = "record_id long, bundle string, frame int, offset long, length long"
RECORD_SCHEMA = "record_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"


class BundleWriter:
    """Frames and seek table of one bundle, in memory up to the bundle size."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.body, self.entries, self.pending = bytearray(), [], bytearray()

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, offset in the frame, length) of the record."""
        place = len(self.entries), len(self.pending), len(record)
        self.pending += record
        if len(self.pending) >= self.frame_bytes:
            self.flush()
        return place

    def flush(self) -> None:
        if self.pending:
            packed = self.zstd.compress(bytes(self.pending))
            self.entries.append((len(packed), len(self.pending), xxhash.xxh64_intdigest(bytes(self.pending)) & 0xFFFFFFFF))
            self.body += packed
            self.pending = bytearray()

    def finish(self) -> bytes:
        self.flush()
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), DESCRIPTOR, SEEKABLE)
        return bytes(self.body) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int, int]]:
    """(start, compressed size, size, checksum) of each frame, from the footer."""
    n, descriptor, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or descriptor != DESCRIPTOR:
        raise ValueError("no seek table")
    entries = list(struct.iter_unpack("<III", bundle[-9 - 12 * n : -9]))
    at, out = 0, []
    for packed, size, check in entries:
        out.append((at, packed, size, check))
        at += packed
    return out


def read_frame(bundle: bytes, frame: tuple[int, int, int, int]) -> bytes:
    at, packed, size, check = frame
    data = zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=size)
    if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise ValueError("frame checksum differs")
    return data


def warc_record(record_id, kind: str, refers_to, url, date: str, payload: bytes, size: int, digest: str) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ID.format(record_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    head.append(f"X-Payload-Length: {size}")
    if kind == "revisit":
        head.append(f"WARC-Refers-To: {ID.format(refers_to)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    else:
        head.append("Content-Type: text/html; charset=utf-8")
    head.append(f"Content-Length: {len(payload)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """(headers, content, where the next record begins)."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    size = int(head["Content-Length"])
    start = end + 4
    return head, data[start : start + size], start + size + 4


def number(urn: str | None):
    text = urn.removeprefix("<urn:edgelight:record:").removesuffix(">") if urn else "None"
    return None if text == "None" else int(text)


def content(payload_col: str) -> Column:
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    return F.struct(F.octet_length(payload).alias("size"), F.sha1(payload).alias("sha1"), F.sha2(payload, 256).alias("sha256")).alias("content")


def roles(records: DataFrame, id_col: str, payload_col: str, min_dedup: int) -> DataFrame:
    """(id, content, last) of revisits, from digests only; last is the id of the response."""
    small = records.select(F.col(id_col).cast("long").alias("id"), content(payload_col))
    most = small.where(F.col("content.size") >= min_dedup).groupBy("content").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("content", "last")
    # written out, so that both sides of the join are dealt by content and a hot one can be split
    most = materialize(most, "copies")
    most = small_side(most, most.count(), BROADCAST_ROWS)
    # only copies other than the last get a row here; all other records are responses
    return small.join(most, "content").where("id < last").select("id", "content", "last").distinct()


def write_bundles(records: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_dedup: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The bundles' index rows (lazy: bundles are written as the rows are computed). folder: a URI that all executors can write."""
    back = roles(records, id_col, payload_col, min_dedup)
    rows = records.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"), content(payload_col))
    rows = rows.join(back, ["id", "content"], "left").select("id", "url", "payload", "last")

    def run(batches):
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        part, attempt, n = context.partitionId(), context.taskAttemptId(), 0
        writer, index = BundleWriter(frame_bytes), []

        def close():
            nonlocal writer, index, n
            name = f"part-{part:06d}-{attempt}-{n:05d}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(writer.finish())
            columns = [pa.array([x[i] for x in index], kind) for i, kind in ((0, pa.int64()), (1, pa.int32()), (2, pa.int64()), (3, pa.int64()))]
            batch = pa.RecordBatch.from_arrays([columns[0], pa.array([name] * len(index), pa.string()), *columns[1:]], ["record_id", "bundle", "frame", "offset", "length"])
            writer, index, n = BundleWriter(frame_bytes), [], n + 1
            return batch

        for batch in batches:
            for i in range(len(batch)):
                key, url, payload, last = (batch.column(c)[i].as_py() for c in range(4))
                body = (payload or "").encode()
                digest = base32_sha1(body)
                kind = "revisit" if last is not None else "response"
                record = warc_record(key, kind, last, url, date, b"" if last is not None else body, len(body), digest)
                index.append((key, *writer.add(record)))
                if len(writer.body) + len(writer.pending) >= bundle_bytes:
                    yield close()
        if index:
            yield close()

    return rows.mapInArrow(run, INDEX_SCHEMA)


def read_bundles(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of index rows, each from its place: footer, seek table, one frame at a time, the record at its offset.

    Reading starts from index rows, so a bundle that a lost or repeated task left behind is never read. Length and digest
    of a response are taken from its stored payload, and a payload that differs from its headers is an error; those of a revisit,
    which has no payload, are its headers'.
    """
    place = ["bundle", "frame", "offset"]

    def run(batches):
        store, base = pafs.FileSystem.from_uri(folder)
        now, table, frame, data = None, [], None, b""
        for batch in batches:
            rows, size = [], 0
            for bundle, at, offset in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in place)):
                if bundle != now:
                    now, frame = bundle, None
                    with store.open_input_file(f"{base}/{bundle}") as f:
                        table = footer(f)
                if at != frame:
                    with store.open_input_file(f"{base}/{bundle}") as f:
                        f.seek(table[at][0])
                        data, frame = read_frame(f.read(table[at][1]), (0, *table[at][1:])), at
                rows.append(as_row(data, offset, payloads))
                size += len(rows[-1][-1] or b"")
                if size >= FRAME_BYTES:
                    yield record_batch(rows)
                    rows, size = [], 0
            yield record_batch(rows)

    rows = index.select(*place)
    # as many tasks as bundles, whose size is bounded
    n = max(1, rows.select("bundle").distinct().count())
    return rows.repartition(n, "bundle").sortWithinPartitions(*place).mapInArrow(run, RECORD_SCHEMA)


def as_row(data: bytes, offset: int, payloads: bool) -> tuple:
    head, body, _ = parse_record(data, offset)
    size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (len(body), base32_sha1(body)) != (size, digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its headers")
    return number(head["WARC-Record-ID"]), head["WARC-Type"], number(head.get("WARC-Refers-To")), head.get("WARC-Target-URI"), size, digest, body if payloads else None


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["record_id", "record_type", "refers_to", "url", "payload_bytes", "payload_digest", "payload"])


def base32_sha1(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def footer(f) -> list[tuple[int, int, int, int]]:
    """The seek table at the end of an open bundle."""
    size = f.size()
    f.seek(size - 9)
    n = struct.unpack("<IBI", f.read(9))[0]
    f.seek(size - 9 - 12 * n)
    return seek_table(f.read(12 * n + 9))


def read_record(folder: str, bundle: str, frame: int, offset: int) -> tuple[dict, bytes]:
    """One record by its index entry: reads the footer and one frame, not the bundle."""
    store, base = pafs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{base}/{bundle}") as f:
        entries = footer(f)
        f.seek(entries[frame][0])
        packed = f.read(entries[frame][1])
    head, body, _ = parse_record(read_frame(packed, (0, *entries[frame][1:])), offset)
    return head, body
