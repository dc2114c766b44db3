"""Token ids in wavelet-matrix files.

A shard file holds segments of about SEGMENT_TOKENS ids, each followed by a newline byte, at most
FILE_SEGMENTS of them.  A segment is a header, a table of part sizes and its parts: document ids,
tokens of each document, a rank directory, and a wavelet matrix over the ids: a bit-plane for each
bit of an id, from the highest, every plane reordered by the planes above it.  Planes are cut into
blocks of BLOCK_BITS; the directory holds the ones of every plane before each RANK_BITS bits, from
which both rank and select start.  Parts and blocks are compressed by zstandard each on its own, so
`access`, `count`, `select` and `occurrences` of a TokenFile read headers, directories and the
blocks that hold the bits they ask for.

    "CWM2" | levels u32 | documents u64 | tokens u64 | body u64 | part sizes u32 * (3 + levels * blocks) | parts

Defined results: text null or empty is only the end id; documents stand in ascending doc_id order,
null first, equal ids by text hash; rows that share a doc_id keep a row each; columns other than
doc_id and text are ignored.  A very long text is one slice and lies in one segment, so a task holds
the longest text of its partition and about twenty times its bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkwell.llm._shared import bound_batches, file_order, materialise, ranges, read_blobs, release_memory, shared_dir, slices, span_hashes, string_parts, write_blobs

MAGIC, HEADER = b"CWM2", struct.Struct("<4sIQQQ")
RANK_BITS, BLOCK_BITS = 1 << 12, 1 << 18
SEGMENT_TOKENS, FILE_SEGMENTS = 1 << 20, 32
SLICE_BYTES = 4 << 20
CACHED_PIECES = 1 << 20
NO_ID = np.iinfo(np.int64).min


class WaveletMatrix:
    """A sequence of ids below 2 ** levels, as bit-planes in blocks that `load` gives by level and number."""

    def __init__(self, load: Callable[[int, int], np.ndarray], directory: np.ndarray, size: int) -> None:
        self.load, self.directory, self.size, self.levels = load, directory, size, len(directory)

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        planes, now = [], ids
        for bit in range(levels - 1, -1, -1):
            ones = (now & now.dtype.type(1 << bit)).astype(bool)
            planes.append(np.packbits(ones))
            if bit:
                now = np.concatenate([now[~ones], now[ones]])
        step, directory = RANK_BITS // 8, np.zeros((levels, -(-len(ids) // RANK_BITS) + 1), dtype=np.uint32)
        for level, plane in enumerate(planes):
            counts = np.bitwise_count(plane)
            whole = np.zeros((directory.shape[1] - 1) * step, dtype=np.uint8)
            whole[: len(counts)] = counts
            directory[level, 1:] = np.cumsum(whole.reshape(-1, step).sum(axis=1, dtype=np.uint32))
        width = BLOCK_BITS // 8
        return cls(lambda level, k: planes[level][k * width : (k + 1) * width], directory, len(ids))

    def _bits(self, level: int) -> np.ndarray:
        blocks = [self.load(level, k) for k in range(-(-self.size // BLOCK_BITS))]
        return np.unpackbits(np.concatenate(blocks), count=self.size).view(bool) if blocks else np.zeros(0, bool)

    def _near(self, level: int, at: int) -> np.ndarray:
        """The bits from the last entry of the directory before a place on, at most RANK_BITS."""
        start = at // RANK_BITS * RANK_BITS
        block = self.load(level, start // BLOCK_BITS)
        first = start % BLOCK_BITS // 8
        return np.unpackbits(block[first : first + RANK_BITS // 8])

    def _rank(self, level: int, at: int) -> int:
        """Ones of a plane before a place."""
        ones, rest = int(self.directory[level, at // RANK_BITS]), at % RANK_BITS
        return ones + int(self._near(level, at)[:rest].sum()) if rest else ones

    def _zeros(self, level: int) -> int:
        return self.size - int(self.directory[level, -1])

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.size:
            raise IndexError(at)
        out = 0
        for level in range(self.levels):
            near = self._near(level, at)
            one, ones = int(near[at % RANK_BITS]), self._rank(level, at)
            at = self._zeros(level) + ones if one else at - ones
            out = out << 1 | one
        return out

    def _narrow(self, token: int, start: int, stop: int) -> tuple[int, int]:
        for level in range(self.levels):
            a, b = self._rank(level, start), self._rank(level, stop)
            if token >> (self.levels - 1 - level) & 1:
                start, stop = self._zeros(level) + a, self._zeros(level) + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of an id between two places."""
        if not 0 <= token < 1 << self.levels:
            return 0
        a, b = self._narrow(token, start, self.size if stop is None else stop)
        return b - a

    def _nth(self, level: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Places of the nth (from 0, ascending) ones or zeros of a plane: the directory names the bits to read."""
        before = self.directory[level].astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(len(before)) * RANK_BITS, self.size) - before
        part = np.searchsorted(before, nth, side="right") - 1
        out = np.empty_like(nth)
        cuts = np.flatnonzero(np.diff(part)) + 1
        for i, j in zip([0, *cuts], [*cuts, len(nth)], strict=True):
            k = int(part[i])
            found = np.flatnonzero(self._near(level, k * RANK_BITS) == bit)
            out[i:j] = k * RANK_BITS + found[nth[i:j] - before[k]]
        return out

    def _up(self, token: int, places: np.ndarray) -> np.ndarray:
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            places = self._nth(level, bit, places - self._zeros(level) if bit else places)
        return places

    def select(self, token: int, nth: int) -> int:
        """The place of the nth (from 0) occurrence of an id."""
        if not 0 <= nth < self.count(token):
            raise IndexError(nth)
        return int(self._up(token, np.array([self._narrow(token, 0, self.size)[0] + nth]))[0])

    def occurrences(self, token: int) -> np.ndarray:
        """All places of an id, ascending."""
        if not self.count(token):
            return np.zeros(0, dtype=np.int64)
        return self._up(token, np.arange(*self._narrow(token, 0, self.size)))

    def decode(self) -> np.ndarray:
        """The whole sequence."""
        now = np.zeros(self.size, dtype=np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            ones, before = self._bits(level), np.empty_like(now)
            zeros = self._zeros(level)
            before[~ones] = now[:zeros]
            before[ones] = now[zeros:] | now.dtype.type(1 << (self.levels - 1 - level))
            now = before
        return now


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, levels: int) -> bytes:
    """A segment."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    matrix = WaveletMatrix.build(ids, levels)
    parts = [squeeze(x.tobytes()) for x in (doc_ids.astype("<i8"), lengths.astype("<i8"), matrix.directory.astype("<u4"))]
    parts += [squeeze(matrix.load(level, k).tobytes()) for level in range(levels) for k in range(-(-len(ids) // BLOCK_BITS))]
    body = struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)
    return HEADER.pack(MAGIC, levels, len(doc_ids), len(ids), len(body)) + body


class Segment:
    """A segment of a file that `read` (offset, length) gives; parts are read when they are asked for."""

    def __init__(self, read: Callable[[int, int], bytes], at: int) -> None:
        magic, self.levels, self.documents, self.size, body = HEADER.unpack(read(at, HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a wavelet file")
        self.read, at = read, at + HEADER.size
        self.end = at + body + 1  # the newline after a segment
        self.blocks = -(-self.size // BLOCK_BITS)
        count = 3 + self.levels * self.blocks
        sizes = np.frombuffer(read(at, 4 * count), dtype="<u4").astype(np.int64)
        self.places = at + 4 * count + np.concatenate(([0], np.cumsum(sizes)))
        self._matrix: WaveletMatrix | None = None

    def _part(self, k: int) -> bytes:
        a, b = int(self.places[k]), int(self.places[k + 1])
        return zstandard.ZstdDecompressor().decompress(self.read(a, b - a))

    def doc_ids(self) -> np.ndarray:
        return np.frombuffer(self._part(0), dtype="<i8")

    def lengths(self) -> np.ndarray:
        return np.frombuffer(self._part(1), dtype="<i8")

    def matrix(self) -> WaveletMatrix:
        if self._matrix is None:
            directory = np.frombuffer(self._part(2), dtype="<u4").reshape(self.levels, -1)
            load = lambda level, k: np.frombuffer(self._part(3 + level * self.blocks + k), dtype=np.uint8)
            self._matrix = WaveletMatrix(load, directory, self.size)
        return self._matrix


class TokenFile:
    """Random access to the ids of a whole shard file, from a function that reads (offset, length) of it."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        self.segments: list[Segment] = []
        at = 0
        while at < size:
            self.segments.append(Segment(read, at))
            at = self.segments[-1].end
        self.first = np.concatenate(([0], np.cumsum([s.size for s in self.segments]))).astype(np.int64)

    @classmethod
    def of(cls, content: bytes) -> TokenFile:
        return cls(lambda at, length: content[at : at + length], len(content))

    def __len__(self) -> int:
        return int(self.first[-1])

    def access(self, at: int) -> int:
        """The id at a place of the file."""
        if not 0 <= at < len(self):
            raise IndexError(at)
        k = int(np.searchsorted(self.first, at, side="right")) - 1
        return self.segments[k].matrix().access(at - int(self.first[k]))

    def count(self, token: int) -> int:
        """Occurrences of an id in the file."""
        return sum(s.matrix().count(token) for s in self.segments)

    def select(self, token: int, nth: int) -> int:
        """The place of the nth (from 0) occurrence of an id."""
        for segment, first in zip(self.segments, self.first.tolist(), strict=False):
            here = segment.matrix().count(token)
            if 0 <= nth < here:
                return first + segment.matrix().select(token, nth)
            nth -= here
        raise IndexError(token)

    def occurrences(self, token: int) -> np.ndarray:
        """All places of an id in the file, ascending."""
        found = [s.matrix().occurrences(token) + f for s, f in zip(self.segments, self.first.tolist(), strict=False)]
        return np.concatenate([np.zeros(0, np.int64), *found])


class Pieces:
    """Ids of pieces by the hash of their bytes; at most CACHED_PIECES are kept between slices.

    Hashes stand sorted in two tables, so that a slice's new ones are merged into the small one only.
    """

    def __init__(self, dtype: np.dtype) -> None:
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.tables = [none, none]
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of hashes, -1 for unknown ones."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        for keys, rows in self.tables:
            if len(keys):
                place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                out = np.where(keys[place] == hashes, rows[place], out)
        return out

    def add(self, hashes: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        rows = np.arange(len(self.size), len(self.size) + len(size), dtype=np.int32)
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        large, small = self.tables
        small = self._merged(small, (hashes, rows))
        if 4 * len(small[0]) > len(large[0]):
            large, small = self._merged(large, small), (hashes[:0], rows[:0])
        self.tables = [large, small]

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, rows = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(keys, kind="stable")
        return keys[order], rows[order]


def _classes() -> np.ndarray:
    """Of bytes: 1 letters, 2 digits, 3 other visible characters of ASCII, 4 blank and newline, 0 the rest."""
    out = np.zeros(256, dtype=np.uint8)
    out[0x21:0x7F] = 3
    for a, b, kind in ((0x30, 0x39, 2), (0x41, 0x5A, 1), (0x61, 0x7A, 1)):
        out[a : b + 1] = kind
    out[[0x0A, 0x20]] = 4
    return out


class Encoder:
    """Whole-text ids of a byte-level BPE tokenizer, a distinct piece at a time.

    Such a tokenizer cuts a text before it encodes what lies between the cuts, each on its own.  Among
    its cuts are those before each blank that follows no blank, and those between a run of letters or
    of digits and a character of another kind, so what lies between these can be encoded on its own
    too, and equal pieces (of equal 64-bit hash) have equal ids.  Kinds are told by bytes, for ASCII
    and two-byte Latin letters; no cut is made beside other characters.  Texts with adjoining blanks,
    or with the tokenizer's added tokens, are encoded whole.
    """

    CLASSES = _classes()

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.levels = max(1, (size - 1).bit_length())
        self.dtype = np.dtype("<u2" if self.levels <= 16 else "<u4")
        self.opens = np.zeros(size, dtype=bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.opens[k] = token.startswith("Ġ")
        added = "".join(rf"|\Q{t.content}\E" for t in self.tokenizer.get_added_tokens_decoder().values())
        self.odd = r"[\s\x0b\x{85}\p{Z}]{2}" + added
        self.known = Pieces(self.dtype)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start, and which bytes belong to letters."""
        kind = self.CLASSES[raw]
        high = np.flatnonzero(raw >= 0x80)
        high = high[high > 0]
        lead, tail = raw[high - 1], raw[high]
        latin = high[(lead >= 0xC3) & (lead <= 0xC8) & ~((lead == 0xC3) & ((tail == 0x97) | (tail == 0xB7)))]
        kind[latin] = 1  # the last byte of a letter; its first is no place for a cut
        starts = kind == 4
        run = (kind[:-1] == 1) | (kind[:-1] == 2)
        starts[1:] |= run & (kind[:-1] != kind[1:]) & (kind[1:] > 0)
        starts[offsets[:-1][offsets[:-1] < len(raw)]] = True
        letters = kind == 1
        letters[latin - 1] = True
        return np.flatnonzero(starts), letters

    def _learn(self, hashes: np.ndarray, raw: np.ndarray, letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Ids of new pieces: a blank and letters a thousand at a time, the rest on their own."""
        size = end - start
        inside = np.add.reduceat(letters[ranges(start, size)], np.cumsum(size) - size, dtype=np.int64)
        plain = (raw[start] == 0x20) & (inside == size - 1) & (size > 1)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        hashes, start, size = hashes[order], start[order], size[order]
        count = int(plain.sum())
        data = raw[ranges(start, size)].tobytes()
        at = np.concatenate(([0], np.cumsum(size)))
        cuts = [*at[:count:1000].tolist(), int(at[count])] if count else []
        joined = [data[a:b].decode("utf-8") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        flat = np.concatenate([np.zeros(0, self.dtype), *self._whole(joined)])
        first = np.flatnonzero(self.opens[flat])
        if len(first) != count:  # a vocabulary whose words do not all begin with the mark of a blank
            each = self._whole([data[a:b].decode("utf-8") for a, b in zip(at[:count].tolist(), at[1 : count + 1].tolist(), strict=True)])
            flat, lengths = np.concatenate([np.zeros(0, self.dtype), *each]), np.array([len(x) for x in each], dtype=np.int64)
        else:
            lengths = np.diff(np.append(first, len(flat)))
        rest = self._whole([data[a:b].decode("utf-8") for a, b in zip(at[count:-1].tolist(), at[count + 1 :].tolist(), strict=True)])
        self.known.add(hashes, np.concatenate([lengths, np.array([len(x) for x in rest], dtype=np.int64)]), np.concatenate([flat, *rest]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self.odd)
        raw, offsets = string_parts(pc.if_else(odd, "", texts))
        if len(raw):
            start, letters = self._cut(raw, offsets)
            end = np.append(start[1:], len(raw))
            codes, distinct = pd.factorize(span_hashes(raw, start, end))
            if len(self.known.size) > CACHED_PIECES:
                self.known.clear()
            rows = self.known.find(distinct)
            new = np.flatnonzero(rows < 0)
            if len(new):
                first = np.zeros(len(distinct), dtype=np.int64)
                first[codes[::-1]] = np.arange(len(codes))[::-1]
                first = first[new]
                self._learn(distinct[new], raw, letters, start[first], end[first])
                rows[new] = self.known.find(distinct[new])
            at, size = self.known.at[rows][codes], self.known.size[rows][codes]
            ids = self.known.flat[ranges(at, size)]
            bounds = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(start, offsets)]
        else:
            ids, bounds = np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        lengths = np.diff(bounds)
        which = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(which):
            parts = np.split(ids, bounds[1:-1])
            for i in which:  # a text at a time: an odd text may be long
                parts[i] = self._whole([texts[int(i)].as_py()])[0]
                lengths[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, lengths


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write documents (doc_id, text) as shard files below `path`, in ascending doc_id order over all."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        docs: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            value = pack(np.concatenate(docs), np.concatenate(counts), np.concatenate(held), enc.levels)
            return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], names=["value"])

        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                ids, lengths = enc.encode(batch.column("text"))
                at = np.cumsum(lengths)
                ids = np.insert(ids, at, enc.dtype.type(end_id))
                docs.append(pc.fill_null(batch.column("doc_id"), int(NO_ID)).to_numpy(zero_copy_only=False))
                counts.append(lengths + 1)
                held.append(ids)
                n += len(ids)
                if n >= SEGMENT_TOKENS:
                    yield flush()
                    docs, counts, held, n = [], [], [], 0
        if docs:
            yield flush()

    bound_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    write_blobs(dealt.mapInArrow(segments, "value binary"), path, most=FILE_SEGMENTS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of shard files: file, doc_id, start among all ids, n_tokens, ids_crc32."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                before = 0
                for segment in TokenFile.of(batch.column("content")[k].as_buffer().to_pybytes()).segments:
                    docs, counts, ids = segment.doc_ids(), segment.lengths(), segment.matrix().decode()
                    stop = np.cumsum(counts)
                    crc = [zlib.crc32(ids[b - c : b].astype("<u4").tobytes()) for b, c in zip(stop.tolist(), counts.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column("path")[k].as_py()] * len(docs)), pa.array(docs, mask=docs == NO_ID), pa.array(before + stop - counts), pa.array(counts), pa.array(crc, pa.int64())],
                        names=["file", "doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    before += int(stop[-1]) if len(stop) else 0
            release_memory()

    rows = materialise(read_blobs(spark, path).mapInArrow(documents, "file string, doc_id long, start long, n_tokens long, ids_crc32 long"), "tokens")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # a row a file
    order = Window.orderBy(file_order(F.col("file"))).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(order), F.lit(0))
    return rows.join(files.select("file", before.alias("before")), "file").select(
        "file", "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def tokens(documents: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files into the shared folder, then read them back."""
    spark = documents.sparkSession
    path = shared_dir(spark, "wavelet")
    write(documents, path, tokenizer, end_id)
    return read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
