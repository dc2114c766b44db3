"""Benchmark passages in documents, by fingerprints of item-sized windows.

Words are blank-separated, in lower case; shingles are five words, or a shorter item whole.  Every
window of a document with as many words as some item, and at least one shingle of some item of
that size (any other has similarity 0), has a 64-bit SimHash over its shingles, each weighted by
how often it occurs; a document of fewer words than an item is one window, whole.  Fingerprints are looked up
in a multi-index: a fingerprint is cut into BLOCKS blocks, and a table for each block lists the items
by every value within RADIUS // BLOCKS bits of the item's, so by pigeonhole no item within RADIUS
bits is missed.  A pair within RADIUS is then
verified by the weighted Jaccard similarity of its shingles, the sum of lesser over the sum of
greater multiplicities, which must be 0.75 or more.  At that similarity fingerprints differ by 11
bits on average; RADIUS lies five deviations beyond, as items of few shingles scatter more, and the
neighbouring windows of a passage are fingerprinted too.  At so low a similarity a radius that misses
nothing lets many pairs of unlike fingerprints through; the bound on common shingles, which is exact,
refutes these before any similarity is computed.

The benchmark is loaded in blocks of at most ITEM_BLOCK items, each block a pass over the documents.

Defined results: null or empty texts and items match nothing; equal items match alike; a match is
the window of greatest similarity, the earliest of equals; rows that share a doc_id are judged
together by their greatest similarity; further columns pass through `drop_contaminated` whatever
their names.  A very long text is a slice of its own: a task holds about a hundred bytes for each of
its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.llm._shared import bound_batches, free_names, gram_hashes, materialise, ranges, slices, split_words

WORDS, SIMILARITY = 5, 0.75
BITS, RADIUS, BLOCKS = 64, 28, 8
ITEM_BLOCK = 20_000
PAIRS = 1 << 20
#: Bytes of text that a task cuts into words at once.
SLICE = 1 << 20
_SIEVE = 1 << 22


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Each hash as 64 values of 1 or -1."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _seal(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of summed bits; a sum of 0 is a 0."""
    return np.packbits(sums > 0, axis=1)


def simhash(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a bag of shingle hashes, as 8 bytes."""
    return _seal(_bits(hashes).sum(axis=0, keepdims=True))[0]


def weighted_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags of (sorted distinct shingles, multiplicities)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common)) if common else 0.0


class Family:
    """The items of one number of words, with the tables of their fingerprint blocks."""

    def __init__(self, words: int, items: list[tuple[int, np.ndarray]]) -> None:
        self.words, self.size = words, min(WORDS, words)
        self.shingles = words - self.size + 1
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.bags = [np.unique(h, return_counts=True) for _, h in items]
        self.prints = np.stack([simhash(h) for _, h in items])
        near = np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8)) <= RADIUS // BLOCKS).astype(np.uint8)
        #: by block: the items by every value near theirs, one value after another, and where each value's begin
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        for block in range(BLOCKS):
            values = (self.prints[:, block][:, None] ^ near[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            self.tables.append(((order // len(near)).astype(np.int32), np.searchsorted(values[order], np.arange(257))))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (fingerprint, item) within RADIUS bits; fingerprints are taken so many at a time that keys stay within PAIRS."""
        step = max(1, PAIRS // (BLOCKS * len(self.ids)))
        parts = [self._candidates(prints[at : at + step]) for at in range(0, len(prints), step)]
        rows = [row + step * k for k, (row, _) in enumerate(parts)]
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none, *(item for _, item in parts)])

    def _candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, keys = len(self.ids), []
        for block, (items, begin) in enumerate(self.tables):
            value = prints[:, block].astype(np.int64)
            count = begin[value + 1] - begin[value]
            keys.append(np.repeat(np.arange(len(prints)), count) * size + items[ranges(begin[value], count)])
        seen = np.zeros(len(prints) * size, dtype=bool)
        for key in keys:
            seen[key] = True
        row, item = np.divmod(np.flatnonzero(seen), size)
        near = np.bitwise_count(prints[row] ^ self.prints[item]).sum(axis=1) <= RADIUS
        return row[near], item[near]


class Index:
    """Items by number of words, and the shingles of all by shingle size."""

    def __init__(self, ids: list[int], texts: list[str | None]) -> None:
        words = split_words(pc.utf8_lower(pa.array(texts, pa.large_string())))
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, i in enumerate(ids):
            own = words.hash[words.ptr[k] : words.ptr[k + 1]]
            if len(own):
                by.setdefault(len(own), []).append((i, gram_hashes(own, min(WORDS, len(own)))))
        self.families = [Family(n, items) for n, items in sorted(by.items())]
        #: by shingle size: known shingles, a sieve of them, and the families of each as runs of one array
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in {f.size for f in self.families}:
            own = [(k, np.unique(np.concatenate([b[0] for b in f.bags]))) for k, f in enumerate(self.families) if f.size == size]
            grams, owner = np.concatenate([g for _, g in own]), np.concatenate([np.full(len(g), k) for k, g in own])
            order = np.argsort(grams, kind="stable")
            known, first = np.unique(grams[order], return_index=True)
            sieve = np.zeros(_SIEVE, dtype=bool)
            sieve[known & np.uint64(_SIEVE - 1)] = True
            self.grams[size] = known, sieve, owner[order], np.append(first, len(grams))

    def matches(self, words: np.ndarray, ptr: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        """(text, item id, similarity, first word) of every pair similar enough, its best window."""
        for size, (known, sieve, owner, runs) in self.grams.items():
            grams = gram_hashes(words, size)
            at = np.flatnonzero(sieve[grams & np.uint64(_SIEVE - 1)])
            place = np.searchsorted(known, grams[at])
            real = known[np.minimum(place, len(known) - 1)] == grams[at]
            at, place = at[real], place[real]
            text = np.searchsorted(ptr, at, side="right") - 1
            inside = at + size <= ptr[text + 1]
            at, place, text = at[inside], place[inside], text[inside]
            count = runs[place + 1] - runs[place]
            family, at, text = owner[ranges(runs[place], count)], np.repeat(at, count), np.repeat(text, count)
            order = np.lexsort((at, family, text))
            family, at, text = family[order], at[order], text[order]
            edges = [0, *(np.flatnonzero((np.diff(text) != 0) | (np.diff(family) != 0)) + 1), len(at)] if len(at) else []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                t, one = int(text[i]), self.families[family[i]]
                a, b = int(ptr[t]), int(ptr[t + 1])
                yield from self._text(t, one, grams[a : b - size + 1], at[i:j] - a)

    def _text(self, t: int, family: Family, own: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        n = min(family.shingles, len(own))
        cover = np.zeros(len(own) + 1, dtype=np.int64)
        np.add.at(cover, np.maximum(hits - n + 1, 0), 1)
        np.add.at(cover, np.minimum(hits + 1, len(own)), -1)
        shared = np.cumsum(cover[: len(own) - n + 1])
        starts = np.flatnonzero(shared > 0)
        best: dict[int, tuple[float, int]] = {}
        for cut in range(0, len(starts), 4096):
            part = starts[cut : cut + 4096]
            low = int(part[0])
            sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_bits(np.ascontiguousarray(own[low : int(part[-1]) + n])), axis=0, dtype=np.int32)])
            prints = _seal(sums[part - low + n] - sums[part - low])
            for row, item in zip(*family.candidates(prints), strict=True):
                start = int(part[row])
                if shared[start] < SIMILARITY * (n + family.shingles - shared[start]):
                    continue  # it cannot have more shingles in common than stand in the window
                value = weighted_similarity(family.bags[item], np.unique(own[start : start + n], return_counts=True))
                if value >= SIMILARITY and value > best.get(int(item), (0.0, 0))[0]:
                    best[int(item)] = value, start
        for item, (value, start) in best.items():
            yield t, int(family.ids[item]), value, start


def item_blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in blocks of about ITEM_BLOCK items."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    blocks = -(-rows.count() // ITEM_BLOCK)
    for k in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toPandas().sort_values(["item_id", "text"])
        yield Index(got["item_id"].tolist(), got["text"].tolist())


def find_passages(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word: a row for each document and item that it holds."""
    bound_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, similarity double, first_word long"
    found = [rows.where("false").select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("first_word"))]  # an empty table of Python's starts workers of its own
    for index in item_blocks(benchmark):
        given = rows.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for whole in batches:
                for batch in slices(whole, "text", SLICE):
                    words = split_words(pc.utf8_lower(batch.column("text")))
                    hits = list(given.value.matches(words.hash, words.ptr))
                    ids = batch.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.float64()), pa.array([h[3] for h in hits], pa.int64())],
                        names=["doc_id", "item_id", "similarity", "first_word"],
                    )

        found.append(rows.mapInArrow(run, schema))
    best = F.max_by(F.struct("similarity", "first_word"), F.struct(F.col("similarity"), -F.col("first_word"))).alias("m")
    return reduce(DataFrame.union, found).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.similarity", "m.first_word")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark passage; a row with a null doc_id goes if such a row holds one."""
    (key,) = free_names(documents, "_id")
    hit = materialise(find_passages(documents, benchmark).select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return documents.join(hit, documents.doc_id.eqNullSafe(F.col(key)), "left_anti")
