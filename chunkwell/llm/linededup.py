"""Repeated runs of lines, by winnowing over line hashes.

From every line that is not blank runs a window: the fewest lines from it on that hold MIN_WORDS
words; to every such line runs another, the fewest lines up to it that do.  Whether lines are such a
window depends on them alone.  Any line of a repeated run of MIN_WORDS words or more lies in one that
the run holds whole: in the window to that line, or, if the run has too few words up to it, in the
window from the run's first line.  So deleting repeated windows deletes repeated runs whole, whatever
the lengths of their lines.  Two neighbouring lines that each hold MIN_WORDS words are a window too,
for the blank lines between them.
The least line hash of each window, the last of equals, is a fingerprint with its position; copies of
a window share it.  Only the fingerprints are joined, to find those at two positions or more.  Around
each such position the match is extended both ways over the line hashes, to the ends of every window
whose least line it is; what it extends to is compared, by the pair of its own hash and the
fingerprint (128 bits), with its first occurrence in the corpus, so that no pairs of positions are
made.  Extents that occurred before, in order of doc_id, text hash and line, run into one another
where a longer run repeats, and all their lines are deleted.

Lines are compared by their words, blanks aside.  Defined results: text null has no lines and stays
null; a null doc_id comes first in order; rows equal in doc_id and text are one occurrence, and keep
the same lines; of different texts under one doc_id the one of lesser hash comes first; blank lines
within a deleted run go with it; columns other than doc_id and text are ignored.  A very long text is
a slice of its own: a task holds its lines and about a hundred bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.llm._shared import bound_batches, discard, lookup_by_key, materialise, mix64, sieved, slices, split_words

MIN_WORDS = 50
_LINE, _WINDOW = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25)
_WINDOW_INVERSE = np.uint64(pow(int(_WINDOW), -1, 1 << 64))


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def line_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, line number, number of words and hash of every line with words."""
    words = split_words(texts, fold=False)
    text = np.repeat(np.arange(len(texts)), np.diff(words.ptr))
    breaks = np.flatnonzero(words.data == 0x0A)
    line = np.searchsorted(breaks, words.start)
    if not len(line):
        return text, line, line, np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (line[1:] != line[:-1]))))
    size = np.diff(np.append(first, len(line)))
    place = np.arange(len(line)) - np.repeat(first, size)
    sums = np.add.reduceat(words.hash * _powers(_LINE, int(size.max()))[place], first)
    text = text[first]
    return text, line[first] - np.searchsorted(breaks, words.offsets)[text], size, mix64(sums + size.astype(np.uint64))


def windows(text: np.ndarray, size: np.ndarray, line: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last line, hash and fingerprint position of every window."""
    upto = np.concatenate(([0], np.cumsum(size)))
    last = np.searchsorted(upto, upto[:-1] + least) - 1
    ends = np.searchsorted(text, text, side="right") - 1
    first = np.flatnonzero(last <= ends)
    # windows to a line, but for those that are windows from a line as well
    back = np.searchsorted(upto, upto[1:] - least, side="right") - 1
    to = np.flatnonzero(back >= np.searchsorted(text, text))
    to = to[last[back[to]] != to]
    long = size >= least
    pair = np.flatnonzero(long[:-1] & long[1:] & (text[:-1] == text[1:]))
    first, last = np.concatenate((first, back[to], pair)), np.concatenate((last[first], to, pair + 1))
    scaled = np.concatenate((np.zeros(1, np.uint64), np.cumsum(line * _powers(_WINDOW, len(line)), dtype=np.uint64)))
    whole = mix64((scaled[last + 1] - scaled[first]) * _powers(_WINDOW_INVERSE, len(line) + 1)[first] + (last - first).astype(np.uint64))
    low = first.copy()
    for k in range(1, int((last - first).max(initial=0)) + 1):
        at = np.minimum(first + k, last)
        low = np.where((first + k <= last) & (line[at] <= line[low]), at, low)
    return first, last, whole, low


def _slices(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple]:
    """Batch, text, line numbers, line hashes, and the windows of a slice of documents."""
    for whole in batches:
        for batch in slices(whole, "text"):
            text, number, size, line = line_hashes(batch.column("text"))
            yield batch, text, number, line, windows(text, size, line, least)


def _marks(least: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text, number, line, (*_, low) in _slices(batches, least):
            low = np.unique(low)
            owner = pa.array(text[low])
            columns = [pa.array(line[low].view(np.int64)), batch.column("doc_id").take(owner), batch.column("h").take(owner), pa.array(number[low])]
            yield pa.RecordBatch.from_arrays(columns, names=["mark", "doc_id", "h", "line"])

    return run


def _extents(least: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text, number, line, (first, last, whole, low) in _slices(batches, least):
            owner = pa.array(text[first])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(line[low].view(np.int64)), batch.column("doc_id").take(owner), batch.column("h").take(owner),
                    pa.array(number[first]), pa.array(number[last]), pa.array(whole.view(np.int64)),
                ],
                names=["mark", "doc_id", "h", "first_line", "last_line", "window"],
            )

    return run


def repeated_windows(documents: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, h (hash of the text), first_line, last_line of every window that occurred before."""
    bound_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    # fingerprints at two positions or more
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.col("h"), F.col("line"))
    marks = rows.mapInArrow(_marks(least), "mark long, doc_id long, h long, line long").groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    marks = materialise(marks.where("a <> b").select("mark"), "marks")
    extents = rows.mapInArrow(_extents(least), "mark long, doc_id long, h long, first_line long, last_line long, window long")
    met = materialise(sieved(extents, "mark", marks), "extents")
    order = F.struct(F.col("doc_id").alias("d"), F.col("h").alias("h"), F.col("first_line").alias("l"))
    found = lookup_by_key(met.withColumn("_order", order), ["window", "mark"], F.xxhash64("doc_id", "h", "first_line"), F.col("_order"), "_first")
    found = materialise(found.where(F.col("_order") > F.col("_first")).select("doc_id", "h", "first_line", "last_line"), "repeated")
    discard(marks, met)
    return found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            out: list[tuple] = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if text is None:
                    out.append((0, 0, "", None))
                    continue
                lines = text.split("\n")
                gone = np.zeros(len(lines) + 1, dtype=np.int64)
                for span in spans or ():
                    gone[span["first_line"]] += 1
                    gone[span["last_line"] + 1] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                worded = np.array([bool(x.strip(" \t\n\x0b\x0c\r")) for x in lines])
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                runs = ",".join(f"{a}-{b - 1}" for a, b in zip(edge[::2], edge[1::2], strict=True))
                out.append((int(worded.sum()), int((worded & gone).sum()), runs, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
            columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_lines", "n_removed", "removed", "text"]
            )


def deduplicated(documents: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines and n_removed (lines with words), removed (runs of line numbers from 0), text that is left."""
    gone = repeated_windows(documents, least).groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    gone = gone.agg(F.collect_list(F.struct("first_line", "last_line")).alias("spans"))  # lines of one text
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_lines long, n_removed long, removed string, text string")
