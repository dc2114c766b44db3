"""Shared storage, null-safe columns and word kernels of the training-data operators."""

from __future__ import annotations

import ctypes
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes outside these ASCII blanks.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes that are hashed at once; each worker holds two tables of as many 64-bit numbers.
BLOCK = 1 << 17
ARROW_BYTES = 8 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir; the setting is made only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialise(df: DataFrame, name: str, *by: str, **options: str | int) -> DataFrame:
    """Cut lineage by writing to the shared folder, in files by the values of some columns, and reading back; lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.options(**options).parquet(path, partitionBy=list(by))
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that `materialise` wrote and that no later plan reads; others stay."""
    for table in tables:
        path = _WRITTEN.pop(table, None)
        if path is not None:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at about ARROW_BYTES, if the session has no setting of its own; a longer row is a batch.

    Spark's default counts rows first, so batches of whole texts fill buffers of 64 MB in the JVM and
    as much again in each worker.  The setting stays: plans run after the operator returns.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, ARROW_BYTES)


def remainder(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 marks a held-out row."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3, F.lit(1))


def held_out(doc_id: str | Column) -> Column:
    """True for rows no model may learn from; a null id is held out."""
    return remainder(doc_id) == 1


def lookup_by_key(rows: DataFrame, key: list[str], salt: Column, value: Column, name: str, salts: int = 64) -> DataFrame:
    """Attach the minimum of `value` over each key to its rows without gathering a key in one task.

    The minimum is taken per (key, salt), then per key, and is sent back only to salts that occur,
    so no join task sees more than about 1/salts of a hot key.
    """
    salted = rows.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    parts = salted.groupBy(*key, "_salt").agg(F.min(value).alias("_part"))
    whole = parts.groupBy(*key).agg(F.min("_part").alias(name), F.collect_set("_salt").alias("_salts"))
    back = whole.select(*[F.col(k).alias(f"_r_{k}") for k in key], name, F.explode("_salts").alias("_r_salt"))
    on = F.col("_salt") == F.col("_r_salt")
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return salted.join(back, on, "left").drop("_salt", "_r_salt", *[f"_r_{k}" for k in key])


def spread_join(rows: DataFrame, small: DataFrame, key: str, salt: Column, salts: int = 64) -> DataFrame:
    """Left join with `small`, unique by `key`, whose rows go only to the (key, salt) pairs that occur."""
    salted = rows.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    there = salted.select(F.col(key).alias("_k"), F.col("_salt").alias("_s")).distinct()
    dealt = there.join(small.withColumnRenamed(key, "_r"), F.col("_k") == F.col("_r")).drop("_r")
    return salted.join(dealt, (F.col(key) == F.col("_k")) & (F.col("_salt") == F.col("_s")), "left").drop("_salt", "_k", "_s")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of `df` has it."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name = f"_{name}"
        out.append(name)
    return out


def hash_sample(rows: DataFrame, total: int, most: int, *keys: str) -> DataFrame:
    """At most `most` of `total` rows, chosen by a bound on a hash of their keys, in one partition.

    The bound lies four deviations below the share asked for, so the limit after it cuts nothing but
    rows that repeat a key.
    """
    if total > most:
        share = max(1.0, most - 4 * most**0.5) / total
        rows = rows.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < int(share * (1 << 40)))
    return rows.limit(most)


def fitted(rows: DataFrame, fit: Callable[[pa.Table], object]) -> object | None:
    """What `fit` makes of a bounded table of one partition, in a task: only that reaches the driver; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            value = pickle.dumps(fit(pa.Table.from_batches(held)))
            yield pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], names=["value"])
            release_memory()

    got = rows.mapInArrow(run, "value binary").collect()
    return pickle.loads(got[0]["value"]) if got else None


#: Bits of the filter of `sieved`: 512 bitmaps of 4 KB.
FILTER_BITS = 1 << 24


def sieved(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose `column` is not null and may be among the only column of `keys`, by a filter of FILTER_BITS bits.

    The filter has a fixed size whatever the keys: with very many of them it lets more rows through.
    """
    bucket, bits = free_names(rows, "_bucket", "_bits")
    bit = lambda name: F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))
    made = keys.toDF("_key").groupBy(F.bitmap_bucket_number(bit("_key")).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit("_key"))).alias(bits))
    at = F.bitmap_bit_position(bit(column))
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn(f"{bucket}_", F.bitmap_bucket_number(bit(column))).where(F.col(column).isNotNull())
    joined = found.join(F.broadcast(made), F.col(f"{bucket}_") == F.col(bucket))  # at most 512 rows
    return joined.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


# ---------------------------------------------------------------- word kernels


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _byte_table(fold: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if fold:
        codes[65:91] += np.uint64(32)
    return mix64((codes + np.uint64(1)) * _MULT)


_TABLES = {fold: _byte_table(fold) for fold in (False, True)}
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(BLANKS)] = False
_INVERSE = np.uint64(pow(int(_MULT), -1, 1 << 64))


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(BLOCK, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSES = _powers(_MULT), _powers(_INVERSE)


def _inverse_at(at: np.ndarray) -> np.ndarray:
    """Inverse powers of the base at any byte offset."""
    low, high = _INVERSES[at % BLOCK], at // BLOCK
    if not len(at) or not high.max():
        return low
    step = np.array([pow(int(_INVERSE), int(k) * BLOCK, 1 << 64) for k in range(int(high.max()) + 1)], dtype=np.uint64)
    return low * step[high]


@dataclass
class Words:
    """Words of some texts: byte spans in `data`, 64-bit hashes, and each text's first word."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    ptr: np.ndarray

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def string_parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text offsets (from 0) of a string array; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(array) + 1, offset=array.offset * 8)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def split_words(array: pa.Array, fold: bool = True) -> Words:
    """Hash every word of every text; memory beyond the spans stays within a block of bytes."""
    raw, offsets = string_parts(array)
    inside = _IS_WORD[raw]
    first, last = inside.copy(), inside.copy()
    if len(raw):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < len(raw))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(raw, offsets, start, end, span_hashes(raw, start, end, _TABLES[fold]), np.searchsorted(start, offsets))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _TABLES[False]) -> np.ndarray:
    """64-bit hashes of ascending spans of bytes that do not overlap; `table` has a number for each byte value."""
    total = np.zeros(len(start), dtype=np.uint64)
    carry, scale = np.uint64(0), 1
    step = pow(int(_MULT), BLOCK, 1 << 64)
    for a in range(0, len(raw), BLOCK):
        part = table[raw[a : a + BLOCK]] * _POWERS[: min(BLOCK, len(raw) - a)]
        if scale != 1:
            part *= np.uint64(scale)
        sums = np.empty(len(part) + 1, dtype=np.uint64)
        sums[0] = carry
        np.cumsum(part, out=sums[1:])
        sums[1:] += carry
        i, j = np.searchsorted(start, (a, a + len(part)))
        total[i:j] -= sums[start[i:j] - a]
        i, j = np.searchsorted(end, (a + 1, a + len(part) + 1))
        total[i:j] += sums[end[i:j] - a]
        carry, scale = sums[-1], scale * step % (1 << 64)
    return mix64(total * _inverse_at(start))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive words; runs across texts must be masked by the caller."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        total = total * _SHINGLE + words[k : k + n]
    return mix64(total)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release_memory() -> None:
    """Hand freed memory back to the system: workers outlive their tasks and idle beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch where `limit` bytes of text are reached; a longer text is a slice of its own.

    What the slices took is released after the last of them.
    """
    _, at = string_parts(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    release_memory()


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of start[i] .. start[i] + length[i] - 1."""
    length = np.asarray(length, dtype=np.int64)
    total = int(length.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    stops = np.cumsum(length)
    return np.arange(total) + np.repeat(np.asarray(start, dtype=np.int64) - (stops - length), length)


# ---------------------------------------------------------------- binary files


def write_blobs(rows: DataFrame, path: str, end: int = 0x0A, most: int = 32) -> None:
    """Write binary column `value` as raw bytes, each row followed by the byte `end`; files of at most `most` rows.

    Spark's own committer writes the files, so any store that Spark can write will do and a lost or
    repeated task leaves no trace.  Formats written so must give that byte a place after each row.
    """
    writer = rows.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", chr(end)).option("maxRecordsPerFile", most)
    writer.text(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """The files below `path`: path string, content binary."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def file_order(path: Column) -> Column:
    """Numbers that order the files of one write: of the partition, then of the file within it."""
    number = lambda pattern: F.regexp_extract(path, pattern, 1).cast("long")
    return F.struct(number(r"part-(\d+)").alias("part"), number(r"-c(\d+)\.").alias("file"))
