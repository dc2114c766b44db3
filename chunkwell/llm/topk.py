"""Exact top-k search by inner product over KD-trees, one for each shard.

A shard is at most SHARD_ROWS vectors of a partition; its tree splits at medians of the widest
dimension down to leaves of LEAF rows, and every node keeps a tight bounding box.  Each query goes
through a shard's tree best first: of the nodes not yet opened it opens the one whose box allows the
greatest inner product, and stops when that is below its kth score.  Queries that open the same leaf
are scored together by one matrix product.  Every query starts with a kth score that is attained:
that of its search in a bounded sample of the vectors, propagated to all shards.

Queries come in blocks of at most QUERY_BLOCK, each a pass over the vectors.

Defined results: vectors null, or holding null or non-finite components, take no part; vectors of
another length than a query are no candidates for it; a query's own id is never a candidate; rows
that repeat an id are candidates each, and as a query the least of them counts; ties go to the
smaller id; fewer than k candidates give fewer rows; components and scores beyond the greatest long, of
either sign, are that one; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwell.llm._shared import bound_batches, hash_sample

LEAF, TOGETHER = 512, 256
QUERY_BLOCK = 8192
SEED_ROWS = 2048
SHARD_ROWS = 1 << 18
_LONG = np.iinfo(np.int64)


class Tree:
    """A KD-tree: of every node a bounding box and its children, or the rows of a leaf."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        low, high = [], []
        self.children: list[tuple[int, int] | None] = []
        self.leaves: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def grow(at: np.ndarray) -> int:
            own, node = rows[at], len(low)
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            self.children.append(None)
            if len(at) <= LEAF:
                self.leaves[node] = ids[at], own
                return node
            wide = int((high[node] - low[node]).argmax())
            order, half = np.argpartition(own[:, wide], len(at) // 2), len(at) // 2
            self.children[node] = grow(at[order[:half]]), grow(at[order[half:]])
            return node

        grow(np.arange(len(ids)))
        self.low, self.high = np.stack(low), np.stack(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The greatest inner product that each node's box allows each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def number_type(largest: float, width: int) -> type:
    """A type in which inner products of whole numbers are exact."""
    most = 2 * largest * largest * width
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores, ties to the smaller id."""
    if scores.dtype == object:
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
    else:
        order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(tree: Tree, own: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores): each query's candidates of a shard at or above its kth score, at most k."""
    for first in range(0, len(queries), TOGETHER):
        yield from _search(tree, own, queries, kth, k, range(first, min(first + TOGETHER, len(queries))))


def _search(tree: Tree, own: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int, some: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    bounds = tree.bounds(queries[some.start : some.stop]).tolist()
    limit = {q: kth[q] for q in some}
    open_ = {q: [(-bounds[q - some.start][0], 0)] for q in some}
    none = np.zeros(0, np.int64), np.zeros(0, queries.dtype)
    found = dict.fromkeys(some, none)
    while open_:
        visits: dict[int, list[int]] = {}
        for q in list(open_):
            heap, bound = open_[q], bounds[q - some.start]
            leaf = None
            while heap and leaf is None:
                least, node = heappop(heap)
                if -least < limit[q]:  # and so are all that are left
                    break
                if tree.children[node] is None:
                    leaf = node
                else:
                    for child in tree.children[node]:
                        if bound[child] >= limit[q]:
                            heappush(heap, (-bound[child], child))
            if leaf is None:
                del open_[q]
            else:
                visits.setdefault(leaf, []).append(q)
        for leaf, at in visits.items():
            names, rows = tree.leaves[leaf]
            values = rows @ queries[at].T
            for j, q in enumerate(at):
                good = np.flatnonzero((values[:, j] >= limit[q]) & (names != own[q]))
                if len(good):
                    ids, scores = found[q]
                    found[q] = _best(np.concatenate([ids, names[good]]), np.concatenate([scores, values[good, j]]), k)
                    if len(found[q][0]) == k:
                        limit[q] = max(limit[q], found[q][1][-1])
    for q, (ids, scores) in found.items():
        if len(ids):
            yield q, ids, scores


def _arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy(zero_copy_only=False))


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * component) as long, of the vectors that take part."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query."""
    bound_batches(vectors.sparkSession)
    rows = quantised(vectors, scale)
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    total, queries = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).collect()[0]
    blocks = max(1, -(-queries // QUERY_BLOCK))
    sample = _rows(hash_sample(rows, total, SEED_ROWS, "vec_id"))
    found = [rows.sparkSession.createDataFrame([], "query_id long, best array<struct<score: long, id: long>>")]
    for n in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n) if blocks > 1 else asked
        found.append(_pass(rows, _rows(block), sample, k))
    each = reduce(DataFrame.union, found).groupBy("query_id").agg(F.flatten(F.collect_list("best")).alias("best"))
    # at most k candidates of each shard meet here
    best = F.slice(F.array_sort(F.transform("best", lambda x: F.struct((-x["score"]).alias("less"), x["id"].alias("id")))), 1, k)
    ranked = each.select("query_id", F.posexplode(best).alias("at", "c"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("c.id").alias("vec_id"), (-F.col("c.less")).alias("score"))


def _by_length(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, ids and vectors of the rows (vec_id, v) of each length."""
    part = table.combine_chunks()
    if not part.num_rows:
        return
    ids = part.column("vec_id").chunk(0).to_numpy(zero_copy_only=False)
    flat, size = _arrays(part.column("v").chunk(0))
    at = np.concatenate(([0], np.cumsum(size)))[:-1]
    for w in np.unique(size).tolist():
        mine = np.flatnonzero(size == w)
        yield w, ids[mine], flat[at[mine][:, None] + np.arange(w)[None, :]] if w else np.zeros((len(mine), 0), np.int64)


def _rows(df: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Collected ids and vectors by length; only for bounded tables."""
    return {w: (ids, rows) for w, ids, rows in _by_length(df.toArrow())}


def _typed(asked: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    largest = max(1.0, *(float(np.abs(x.astype(np.float64)).max(initial=1)) for x in (asked, rows)))
    kind = number_type(largest, max(asked.shape[1], 1))
    return asked.astype(kind), rows.astype(kind)


def _pass(rows: DataFrame, queries: dict, sample: dict, k: int) -> DataFrame:
    """The candidates of a block of queries, by shard."""
    given = rows.sparkSession.sparkContext.broadcast(queries)
    starts = {}
    for w, (own, asked) in queries.items():
        kth = np.full(len(own), -np.inf)
        if w in sample:
            typed, rows_of = _typed(asked, sample[w][1])
            if rows_of.dtype == object:
                kth = np.full(len(own), -float("inf"), dtype=object)
            for q, _, scores in search(Tree(sample[w][0], rows_of), own, typed, kth.copy(), k):
                if len(scores) == k:
                    kth[q] = scores.min()
        starts[w] = kth
    first = rows.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SHARD_ROWS:
                yield from shard(held)
                held = []
        if held:
            yield from shard(held)

    def shard(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, ids, own_rows in _by_length(pa.Table.from_batches(held)):
            if w not in given.value:
                continue
            own, asked = given.value[w]
            typed, own_rows = _typed(asked, own_rows)
            names, best = [], []
            for q, near, scores in search(Tree(ids, own_rows), own, typed, first.value[w], k):
                names.append(int(own[q]))
                best.append([{"score": min(max(int(s), -_LONG.max), _LONG.max), "id": int(i)} for s, i in zip(scores, near, strict=True)])
            kind_best = pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(best, kind_best)], names=["query_id", "best"])

    return rows.mapInArrow(run, "query_id long, best array<struct<score: long, id: long>>")
