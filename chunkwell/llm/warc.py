"""Web pages in seekable Zstandard WARC bundles.

A bundle holds WARC/1.1 records grouped into independent Zstandard frames of about FRAME_BYTES, at
most BUNDLE_FRAMES of them, then a skippable frame with the index, then the seek table of the
Zstandard seekable format.  The index maps record identifiers, in ascending order, to the record's
frame, offset in the frame's content and length, and keeps the record's number.  A reader needs the
tail of a bundle to find the records of an identifier and decompresses one frame to get each.  Spark
writes a byte after each row (see write_blobs): each frame is followed by a skippable frame whose
content is that byte, counted with the frame in the seek table, and it is the last byte of the seek
table's own magic number.

Of records with equal payloads of at least `least_bytes` bytes the one with the greatest page_id is
a response and the others revisit it; a revisit stores the payload's digest and length only.

Defined results: null html is an empty payload; rows that share the greatest page_id of a payload
are all responses; a row with a null page_id is never referred to and is a response if its payload
has no other id; null urls are written empty; further columns are ignored.  A very long page is a
frame of its own: a task holds a few times its bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwell.llm._shared import bound_batches, lookup_by_key, read_blobs, shared_dir, slices, write_blobs

FRAME_BYTES, BUNDLE_FRAMES = 1 << 18, 254
NO_ID = np.iinfo(np.int64).min
LEVEL = 3
#: Fixed values of the Zstandard frame and seekable formats.
SKIPPABLE, SEEK_SKIPPABLE, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
END = 0x8F
#: No table has the time of a fetch, so every record has this date.
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of the record that `refers_to` names."""
    block = b"" if refers_to is not None else HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class Bundle:
    """Frames of one bundle in the making; every row that it gives lacks the byte END."""

    def __init__(self) -> None:
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.held: list[bytes] = []
        self.size = 0

    def add(self, page_id: int | None, raw: bytes) -> bytes | None:
        self.index.append((NO_ID if page_id is None else page_id, len(self.frames), self.size, len(raw)))
        self.held.append(raw)
        self.size += len(raw)
        return self.frame() if self.size >= FRAME_BYTES else None

    def frame(self) -> bytes:
        row = self.squeeze.compress(b"".join(self.held)) + _skippable(SKIPPABLE, bytes([END]))[:-1]
        self.frames.append((len(row) + 1, self.size))
        self.held, self.size = [], 0
        return row

    def finish(self) -> Iterator[bytes]:
        if self.held:
            yield self.frame()
        rows = np.array(self.index, dtype="<i8").reshape(-1, 4)
        order = np.argsort(rows[:, 0], kind="stable")
        index = zstandard.ZstdCompressor().compress(np.column_stack([rows[order], order]).astype("<i8").tobytes())
        row = _skippable(SKIPPABLE + 1, index + bytes([END]))[:-1]
        self.frames.append((len(row) + 1, 0))
        yield row
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        yield _skippable(SEEK_SKIPPABLE, entries + footer)[:-1]


class Reader:
    """Random access to the records of a bundle, given its bytes, or its size and a function that reads (offset, length) of it."""

    def __init__(self, content: bytes | Callable[[int, int], bytes], size: int | None = None) -> None:
        self.read = content if callable(content) else lambda at, length: content[at : at + length]
        size = len(content) if size is None else size
        count, _, magic = struct.unpack("<IBI", self.read(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        table = np.frombuffer(self.read(size - 9 - 8 * count, 8 * count), dtype="<u4").reshape(-1, 2).astype(np.int64)
        self.start, self.sizes = np.concatenate(([0], np.cumsum(table[:, 0]))), table[:, 1]
        self.loose = zstandard.ZstdDecompressor()
        raw = self.read(int(self.start[count - 1]) + 8, int(table[count - 1, 0]) - 9)
        rows = np.frombuffer(self.loose.decompress(raw), dtype="<i8").reshape(-1, 5)
        self.ids, self.numbers = rows[:, 0], rows[:, 4]
        #: frame, offset and length by number of the record
        self.index = np.empty((len(rows), 3), dtype=np.int64)
        self.index[self.numbers] = rows[:, 1:4]
        self._frame: tuple[int, bytes] = (-1, b"")

    def __len__(self) -> int:
        return len(self.index)

    def find(self, page_id: int | None) -> list[int]:
        """Numbers of the records of an identifier, ascending."""
        key = NO_ID if page_id is None else page_id
        a, b = np.searchsorted(self.ids, key, side="left"), np.searchsorted(self.ids, key, side="right")
        return self.numbers[a:b].tolist()

    def raw(self, nth: int) -> bytes:
        """The bytes of a record; only its frame is read and decompressed."""
        frame, offset, length = self.index[nth].tolist()
        if self._frame[0] != frame:
            part = self.read(int(self.start[frame]), int(self.start[frame + 1] - self.start[frame]))
            self._frame = frame, self.loose.decompress(part, max_output_size=int(self.sizes[frame]))
        return self._frame[1][offset : offset + length]

    def get(self, page_id: int | None) -> list[tuple[dict[str, str], bytes]]:
        """Headers and block of the records of an identifier."""
        return [parse(self.raw(k)) for k in self.find(page_id)]


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record of each page into bundles below `path`."""
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("_digest", F.sha1(F.col("html").cast("binary")))
    # the greatest id of a payload, through its negative's minimum; nulls last
    found = lookup_by_key(rows, ["_digest"], F.xxhash64("page_id", "url"), -F.col("page_id"), "_least")
    last = F.when(F.octet_length("html") >= least_bytes, -F.col("_least"))
    refers = F.when(~F.col("page_id").eqNullSafe(last), last)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, some = Bundle(), False

        def row(value: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], names=["value"])

        for whole in batches:
            for batch in slices(whole, "html"):
                for page_id, url, html, refers_to in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "html", "refers_to")), strict=True):
                    some = True
                    done = out.add(page_id, record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to))
                    if done is not None:
                        yield row(done)
                    if len(out.frames) == BUNDLE_FRAMES:  # nothing is held now
                        yield from map(row, out.finish())
                        out, some = Bundle(), False
        if some:
            yield from map(row, out.finish())

    chosen = found.select("page_id", "url", "html", refers.alias("refers_to"))
    write_blobs(chosen.mapInArrow(bundle, "value binary"), path, END, BUNDLE_FRAMES + 2)  # a bundle a file


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the bundles below `path`: SCHEMA, then file, record, frame, offset, length."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                content = batch.column("content")[k].as_buffer().to_pybytes()
                if not content:
                    continue
                reader, rows = Reader(content), []
                for nth in range(len(reader)):
                    headers, block = parse(reader.raw(nth))
                    mark = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(headers["WARC-Payload-Length"])
                    if headers["WARC-Type"] == "response":
                        payload = block[len(HTTP) :]
                        size, mark = len(payload), digest(payload)
                    ids = [headers[n][10:-1] if n in headers else "" for n in ("WARC-Record-ID", "WARC-Refers-To")]
                    rows.append((int(ids[0]) if ids[0] else None, size, mark, headers["WARC-Type"], int(ids[1]) if ids[1] else None))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                arrays += [pa.array([batch.column("path")[k].as_py()] * len(rows)), pa.array(range(len(rows)), pa.int64())]
                arrays += [pa.array(np.ascontiguousarray(reader.index[:, c])) for c in range(3)]
                yield pa.RecordBatch.from_arrays(
                    arrays, names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "record", "frame", "offset", "length"]
                )

    return read_blobs(spark, path).mapInArrow(records, f"{SCHEMA}, file string, record long, frame long, offset long, length long")


def archive(pages: DataFrame) -> DataFrame:
    """Write the bundles into the shared folder, then read them back."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write(pages, path)
    return read(spark, path)
