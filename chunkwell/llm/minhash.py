"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index Hamming search.

A signature holds `symbols` minima of 16 bits.  It is cut into `chunks` equal chunks.  If two
signatures differ in at most chunks * (errors + 1) - 1 symbols, then by pigeonhole some chunk
differs in at most `errors` symbols; so a key for each choice of `errors` symbols to leave out of
each chunk makes every such pair meet under at least one key.  At a similarity of 0.75, with the
defaults, a pair has more than 31 of 64 differing symbols about once in 100,000 pairs.

Pairs that meet are confirmed on their full shingle sets, unless an exact bound from the parities of
bucketed shingle counts already refutes them; nothing else rejects.  No group is ever expanded into pairs:
documents with equal sets are one node; every node is first compared with the smallest node of the
key it shares most; then, under keys whose nodes still lie in different components, twice with its
nearest node of another component; then all remaining pairs across components are compared there, in
cells of bounded size.  A pair that is skipped lies within one component already, so the components
are those of all links.

Defined results: text null, empty or blank has no shingles and is linked with nothing; rows with
equal text share a component; a null doc_id has a null component and is kept; rows that share a
doc_id keep a row each; further columns of the input are ignored.  A very long text is a slice of
its own: a task holds about a hundred bytes for each of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.llm._shared import (
    Words,
    bound_batches,
    discard,
    free_names,
    gram_hashes,
    is_empty,
    materialise,
    mix64,
    release_memory,
    sieved,
    slices,
    split_words,
    spread_join,
)
from chunkwell.llm.components import connected_components

WORDS, SIMILARITY = 5, 75
SYMBOLS, CHUNKS, ERRORS = 64, 16, 1
#: A bit for each of this many buckets of shingles tells whether the bucket's count is odd.
PARITY = 2048
CELL = 2048
_SEEDS = mix64(np.arange(1, 2 * SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(words: Words, size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    grams = gram_hashes(words.hash, size)
    out = []
    for a, b in zip(words.ptr[:-1], words.ptr[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(gram_hashes(words.hash[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row for each set, none empty: 16 bits of each of SYMBOLS minima, parities, set size."""
    length = np.array([len(s) for s in sets])
    flat, first = np.concatenate(sets), np.concatenate(([0], np.cumsum(length)[:-1]))
    main = np.empty((len(sets), SYMBOLS), dtype=np.uint16)
    for k in range(SYMBOLS):
        least = mix64(np.minimum.reduceat((flat ^ _SEEDS[2 * k]) * (_SEEDS[2 * k + 1] | np.uint64(1)), first))
        main[:, k] = (least & np.uint64(0xFFFF)).astype(np.uint16)
    odd = np.empty((len(sets), PARITY // 8), dtype=np.uint8)
    for at in range(0, len(sets), 256):
        size = length[at : at + 256]
        bucket = (flat[first[at] : first[at] + size.sum()] % np.uint64(PARITY)).astype(np.int64) + np.repeat(np.arange(len(size)) * PARITY, size)
        counts = np.bincount(bucket, minlength=len(size) * PARITY).reshape(len(size), PARITY)
        odd[at : at + 256] = np.packbits(counts & 1 == 1, axis=1)
    return np.concatenate([main.view(np.uint8).reshape(len(sets), -1), odd, length.astype("<i8").view(np.uint8).reshape(len(sets), 8)], axis=1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = shingle_sets(split_words(batch.column("text")))
            full = [i for i, s in enumerate(sets) if len(s)]
            ids: list[bytes | None] = [None] * len(sets)
            signs: list[bytes | None] = [None] * len(sets)
            if full:
                for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                    ids[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    signs[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(signs, pa.binary())],
                names=["doc_id", "n_shingles", "set_id", "signature"],
            )


def _masks() -> list[tuple[int, list[int]]]:
    """(tag, symbols) of every key: a chunk without `ERRORS` of its symbols."""
    width, out = SYMBOLS // CHUNKS, []
    for c in range(CHUNKS):
        for kept in combinations(range(width), width - ERRORS):
            out.append((len(out), [c * width + k for k in kept]))
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks = _masks()
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            sign = _matrix(batch.column("signature")).main.astype(np.uint64)
            keys = np.empty((len(sign), len(masks)), dtype=np.uint64)
            for tag, symbols in masks:
                key = np.full(len(sign), tag, dtype=np.uint64)
                for s in symbols:
                    key = (key << np.uint64(16)) | sign[:, s]
                keys[:, tag] = key
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), len(masks))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], names=["key", "node"])


@dataclass
class Signatures:
    """The parts of some signatures, a row each."""

    main: np.ndarray
    odd: np.ndarray
    size: np.ndarray

    def __getitem__(self, at: np.ndarray) -> Signatures:
        return Signatures(self.main[at], self.odd[at], self.size[at])


def _matrix(column: pa.Array) -> Signatures:
    cuts = np.cumsum([0, 2 * SYMBOLS, PARITY // 8, 8])
    rows = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), cuts[-1])
    main, odd, size = (np.ascontiguousarray(rows[:, i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True))
    return Signatures(main.view(np.uint16), odd.view(np.uint64), size.view("<i8")[:, 0])


def _least_apart(left: Signatures, right: Signatures) -> np.ndarray:
    """A lower bound of the size of the symmetric difference of two sets.

    Every odd bucket of the symmetric difference holds a shingle that one set lacks, so their number
    bounds it, as the difference of the sizes does.
    """
    odd = np.bitwise_count(left.odd ^ right.odd).sum(axis=1, dtype=np.int64)
    return np.maximum(odd, np.abs(left.size - right.size))


def _may_reach(left: Signatures, right: Signatures) -> np.ndarray:
    """False only where the sets cannot be similar enough.

    With d the size of the symmetric difference, a similarity of SIMILARITY percent or more means
    (100 + SIMILARITY) * d <= (100 - SIMILARITY) * (sum of the sizes).
    """
    return (100 + SIMILARITY) * _least_apart(left, right) <= (100 - SIMILARITY) * (left.size + right.size)


def _alike(left: Signatures, right: Signatures, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (left[p], right[q]) all that the keys guarantee but for those that an exact bound refutes."""
    near = (left.main[p] != right.main[q]).sum(axis=1) < CHUNKS * (ERRORS + 1)
    p, q = p[near], q[near]
    near = _may_reach(left[p], right[q])
    return p[near], q[near]


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of alike signatures."""
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            every = np.arange(part.num_rows)
            near, _ = _alike(_matrix(part.column("sign_a")), _matrix(part.column("sign_b")), every, every)
            yield part.take(pa.array(near)).select(["a", "b"])
        release_memory()


def _first_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first tag under which two signatures meet, so that a pair is handled once; past the last if none."""
    out = np.full(len(left), 1 << 15)
    for tag, symbols in reversed(_masks()):
        out[(left[:, symbols] == right[:, symbols]).all(axis=1)] = tag
    return out


def _within(nearest: bool):  # noqa: ANN202
    """Alike pairs across components within each cell, or each row's nearest one; rows of a cell stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "cell_a", "cell_b")], axis=1)
            if not len(key):
                continue
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(key)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(i, j - i)
                if held and any(held[-1].column(n)[0] != part.column(n)[0] for n in ("key", "cell_a", "cell_b")):
                    yield _cell(held, nearest)
                    held = []
                held.append(part)
        if held:
            yield _cell(held, nearest)
        release_memory()

    return run


def _cell(held: list[pa.RecordBatch], nearest: bool) -> pa.RecordBatch:
    part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    node, label, block = (part.column(n).to_numpy(zero_copy_only=False) for n in ("node", "label", "block"))
    key, a, b = (part.column(n)[0].as_py() for n in ("key", "cell_a", "cell_b"))
    signs = _matrix(part.column("signature"))
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    found = [np.zeros((0, 2), np.int64)]
    for at in range(0, len(left), 32):
        i = left[at : at + 32]
        across = label[i][:, None] != label[right][None, :]
        if a == b and not nearest:
            across &= node[i][:, None] < node[right][None, :]
        x, y = np.nonzero(across)
        p, q = _alike(signs, signs, i[x], right[y])
        if nearest:
            order = np.lexsort((node[q], _least_apart(signs[p], signs[q]), p))
            pick = order[np.unique(p[order], return_index=True)[1]]
        else:
            pick = np.flatnonzero(_first_key(signs.main[p], signs.main[q]) == key >> 16 * (SYMBOLS // CHUNKS - ERRORS))
        found.append(np.stack([node[p[pick]], node[q[pick]]], axis=1))
    pairs = np.sort(np.concatenate(found), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            found = shingle_sets(split_words(batch.column("text")))
            flat = np.concatenate(found).view(np.int64)
            at = np.concatenate(([0], np.cumsum([len(s) for s in found]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["id", "grams"])


def confirm(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of doc ids whose full shingle sets are similar enough, written.

    A set goes to the pairs of its document in as many parts as their hashes have, so a document of
    very many pairs meets them in many tasks.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    wanted = sieved(docs.select("doc_id", "text"), "doc_id", ids)
    full = materialise(wanted.mapInArrow(_sets, "id long, grams array<long>"), "sets")
    side = lambda n: full.select(F.col("id").alias(n), F.col("grams").alias(f"grams_{n}"))
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    union = F.size("grams_a") + F.size("grams_b") - both
    joined = spread_join(spread_join(pairs, side("a"), "a", F.xxhash64("b")), side("b"), "b", F.xxhash64("a"))
    found = materialise(joined.where(both * 100 >= union * SIMILARITY).select("a", "b").distinct(), "confirmed")
    discard(full)
    return found


def _split(shared: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of shared keys with their labels, and the largest component of every key whose nodes are not yet in one, written."""
    named = shared.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialise(named.select("key", "node", "n", "label"), "labelled")
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("size"))
    apart = sizes.groupBy("key").agg(F.max(F.struct("size", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    return named, materialise(apart.select("key", F.col("top.size").alias("top_size"), F.col("top.label").alias("top_label")), "apart")


def _apart(named: DataFrame, apart: DataFrame, signs: DataFrame, nearest: bool) -> DataFrame:
    """Alike pairs across components under keys whose nodes are not yet in one component, written.

    The nodes of a key are cut into blocks of about CELL.  Those of the component that has most of
    them stand in blocks of their own, which are compared with the other blocks only, so beside one
    large component a few other nodes cost a pass over it and not its square.
    """
    members = spread_join(named, apart, "key", F.xxhash64("node")).where("top_size is not null").join(signs, "node")
    cells = lambda size: F.ceil(size / CELL).cast("int")
    small, top = F.col("n") <= CELL, F.col("label") == F.col("top_label")
    rest, most = cells(F.col("n") - F.col("top_size")), cells(F.col("top_size"))
    spread = lambda count: F.pmod(F.xxhash64("node"), count).cast("int")
    block = F.when(small, 0).when(top, rest + spread(most)).otherwise(spread(rest))
    last = F.when(small, 0).when(top, rest - 1).otherwise(rest + most - 1)
    members = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    members = members.select(
        "key", F.least("block", "other").alias("cell_a"), F.greatest("block", "other").alias("cell_b"), "block", "node", "label", "signature"
    )
    dealt = members.repartition("key", "cell_a", "cell_b").sortWithinPartitions("key", "cell_a", "cell_b")
    return materialise(dealt.mapInArrow(_within(nearest), "a long, b long").distinct(), "pairs")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_shingles, component_id, kept; a row per input row."""
    bound_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialise(docs.mapInArrow(_features, "doc_id long, n_shingles long, set_id binary, signature binary"), "signatures")
    full = rows.where("set_id is not null and doc_id is not null")
    nodes = materialise(full.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.min("signature").alias("signature")), "nodes")
    signs = nodes.select("node", "signature")
    keys = signs.mapInArrow(_keys, "key long, node long")

    buckets = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("n"))
    buckets = materialise(buckets.where("hub <> last").select("key", "hub", "n"), "buckets")
    shared = materialise(keys.join(buckets, "key").select("key", "node", "hub", "n"), "shared")
    met = shared.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("times"))
    best = met.groupBy("node").agg(F.max_by("hub", F.struct(F.col("times"), -F.col("hub"))).alias("hub"))
    best = materialise(best.select(F.col("hub").alias("a"), F.col("node").alias("b")), "best")
    pairs = spread_join(best.join(signs.toDF("b", "sign_b"), "b"), signs.toDF("a", "sign_a"), "a", F.xxhash64("b"))  # a hub has very many pairs
    pairs = materialise(pairs.mapInArrow(_close, "a long, b long").distinct(), "pairs")
    links = confirm(docs, pairs)
    labels = connected_components(links)

    tested, written, split = pairs, [best, pairs, links], ()
    for nearest in (True, True, False):
        if split and nearest:
            continue  # the labels are those of the last pass, and so are the nearest nodes
        split = split or _split(shared, labels)
        every = _apart(*split, signs, nearest)
        found = materialise(every.join(tested, ["a", "b"], "left_anti"), "pairs")
        discard(every)
        written.append(found)
        if is_empty(found):
            continue
        tested = tested.union(found)
        again = confirm(docs, found)
        written.append(again)
        if not is_empty(again):
            links, before = links.union(again), labels
            labels = connected_components(links)
            discard(before, *split)
            split = ()
    discard(*split)
    discard(buckets, shared, *written)

    named = nodes.select("set_id", "node").join(labels.select("node", "label"), "node", "left").select("set_id", F.coalesce("label", "node").alias("component"))
    out = spread_join(rows.select("doc_id", "n_shingles", "set_id"), named, "set_id", F.xxhash64("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("component", "doc_id"), "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each_group(documents: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest doc_id stays.

    Rows equal in doc_id and text leave one of them; documents without words, or without doc_id, all
    stay; further columns pass whatever their names.
    """
    key, own = free_names(documents, "_id", "_own")
    kept = near_duplicates(documents).where("kept").select(F.col("doc_id").alias(key)).distinct()
    stay = documents.join(kept, documents.doc_id.eqNullSafe(F.col(key)), "left_semi")
    stay = stay.withColumn(own, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    return stay.dropDuplicates(["doc_id", "text", own]).select(*documents.columns)
