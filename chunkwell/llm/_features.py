"""Hashed features of words, looked up once for each distinct word, and samples to learn from."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.llm._shared import Words, hash_sample, held_out, ranges, slices, span_hashes, split_words

CACHED_WORDS = 200_000


def bucket(kind: str, text: str, buckets: int) -> int:
    """A bucket from 1 on; 0 stands for no feature."""
    return zlib.crc32(f"{kind}:{text}".encode("utf-8", "replace")) % buckets + 1


class WordFeatures:
    """Rows of numbers of words, made once for each distinct word; at most CACHED_WORDS are kept between texts."""

    def __init__(self, width: int, make: Callable[[list[str]], np.ndarray], dtype: type = np.int32) -> None:
        self.make = make
        self.index: dict[int, int] = {}
        self.rows = np.zeros((1024, width), dtype=dtype)

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word among the distinct ones, and the rows of these."""
        if len(self.index) > CACHED_WORDS:
            self.index = {}
        codes, at = self._places(words)
        return codes.astype(np.int64), self.rows[at]

    def keep(self, words: Words) -> np.ndarray:
        """The place of each word in `rows`; nothing is forgotten, so only for bounded samples."""
        codes, at = self._places(words)
        return at[codes].astype(np.int32)

    def _places(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        codes, distinct = pd.factorize(words.hash)
        index = self.index
        at = np.array([index.get(h, -1) for h in distinct.tolist()], dtype=np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            first = np.zeros(len(distinct), dtype=np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            at[new] = np.arange(len(index), len(index) + len(new))
            index.update(zip(distinct[new].tolist(), at[new].tolist(), strict=True))
            while len(self.rows) < len(index):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[at[new]] = self.make([words.text(k) for k in first[new].tolist()])
        return codes, at


def sample(documents: DataFrame, label: str, most: int) -> DataFrame:
    """At most `most` rows (text, label) that may be learnt from, with a label, chosen by a hash of the id."""
    rows = documents.where(~held_out("doc_id")).where(F.col(label).isNotNull())
    found = hash_sample(rows.select("doc_id", "text", F.col(label).cast("string").alias("label")).where("text is not null"), rows.count(), most, "doc_id")
    return found.select("text", "label")


#: Runs of more bytes are no words, and seen at each of their characters, GRAM characters at a time.
LONGEST_WORD, GRAM = 40, 8


def spread_words(words: Words) -> Words:
    """The words, and in place of each run longer than LONGEST_WORD the grams that begin at its characters; in proportion to its length."""
    long = np.flatnonzero(words.end - words.start > LONGEST_WORD)
    if not len(long):
        return words
    size = words.end[long] - words.start[long]
    place, run = ranges(words.start[long], size), np.repeat(np.arange(len(long)), size)
    keep = (words.data[place] & 0xC0) != 0x80
    place, run = place[keep], run[keep]
    stop = np.repeat(words.end[long], np.bincount(run, minlength=len(long)))
    ahead = np.full(len(place), 0, dtype=np.int64)
    ahead[:-GRAM] = place[GRAM:] if len(place) > GRAM else 0
    inside = np.zeros(len(place), dtype=bool)
    inside[:-GRAM] = run[GRAM:] == run[:-GRAM] if len(place) > GRAM else False
    end = np.where(inside, ahead, stop)
    short = np.ones(len(words.start), dtype=bool)
    short[long] = False
    starts, ends = np.concatenate([words.start[short], place]), np.concatenate([words.end[short], end])
    hashes = np.concatenate([words.hash[short], span_hashes(words.data, place, end)])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    return Words(words.data, words.offsets, starts, ends[order], hashes[order], np.searchsorted(starts, words.offsets))


def word_slices(batches: Iterator[pa.RecordBatch], spread: bool = False) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for whole in batches:
        for batch in slices(whole, "text"):
            words = split_words(batch.column("text"), fold=False)
            yield batch, spread_words(words) if spread else words
