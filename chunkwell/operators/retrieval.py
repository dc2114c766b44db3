"""Embedding, nearest neighbours and the union of retrievals."""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from chunkwell.functions.arrays import let
from chunkwell.schema import FILE_KEY

DIMENSIONS = 256
EMBEDDING = "array<struct<bucket: int, weight: long>>"
SPAN = [*FILE_KEY, "start_line", "end_line"]


VECTOR = "array<float>"


class Embedder(Protocol):
    """Adds a column to rows of texts: `embedding`, of type EMBEDDING, if `kind` is sparse; `vector`, of type VECTOR, if it is dense."""

    kind: str

    def add(self, rows: DataFrame, text: str) -> DataFrame: ...


def hashed_counts(text: str, dimensions: int = DIMENSIONS) -> Column:
    """Counts of a text's words by hashed bucket, within the row: buckets are sorted, and their runs measured."""
    words = r"filter(split(lower(_t), r'[^\p{L}\p{N}]+'), w -> w <> '')"
    buckets = f"sort_array(transform({words}, w -> CAST(CAST(conv(substring(md5(CAST(w AS binary)), 1, 8), 16, 10) AS bigint) % {dimensions} AS int)))"
    starts = "filter(sequence(1, size(_b)), i -> i = 1 OR get(_b, i - 2) <> get(_b, i - 1))"
    runs = let("_i", starts, "zip_with(_i, concat(slice(_i, 2, size(_i)), array(size(_b) + 1)), (i, j) -> named_struct('bucket', get(_b, i - 1), 'weight', CAST(j - i AS bigint)))")
    none = f"CAST(array() AS {EMBEDDING})"
    return F.expr(let("_t", f"coalesce({text}, '')", let("_b", buckets, f"CASE WHEN size(_b) > 0 THEN {runs} ELSE {none} END")))


class HashedEmbedder:
    """Counts of words by hashed bucket; a stand-in without a model, exact on every engine."""

    kind = "sparse"

    def add(self, rows: DataFrame, text: str) -> DataFrame:
        return rows.withColumn("embedding", hashed_counts(text))


class VectorModel(Protocol):
    """A model on an executor: texts to rows of `dimensions` floats."""

    dimensions: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


_MODELS: dict[bytes, VectorModel] = {}


def _model(name: bytes, load: Callable[[], VectorModel]) -> VectorModel:
    """A worker's model."""
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


class ModelEmbedder:
    """Dense vectors by a model that each Python worker loads once, over Arrow batches; a null text has no vector."""

    kind = "dense"

    def __init__(self, load: Callable[[], VectorModel], batch: int = 256) -> None:
        self.load, self.batch, self.name = load, batch, uuid.uuid4().bytes

    def add(self, rows: DataFrame, text: str) -> DataFrame:
        load, most, name = self.load, self.batch, self.name
        schema = StructType([*(f for f in rows.schema if f.name != "vector"), StructField("vector", ArrayType(FloatType()))])
        names = [f.name for f in schema][:-1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = _model(name, load)
            for whole in batches:
                for start in range(0, whole.num_rows, most):
                    batch = whole.slice(start, most)
                    texts = batch.column(text)
                    found = np.asarray(model.encode([t or "" for t in texts.to_pylist()]), dtype=np.float32)
                    if found.shape != (batch.num_rows, model.dimensions):
                        raise ValueError(f"the model gave {found.shape} for {batch.num_rows} texts of {model.dimensions} dimensions")
                    ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * model.dimensions)
                    vectors = pa.ListArray.from_arrays(ends, pa.array(found.reshape(-1)))
                    vectors = pc.if_else(texts.is_valid(), vectors, pa.scalar(None, vectors.type))
                    yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), vectors], names=[*names, "vector"])

        return rows.mapInArrow(run, schema)


class HashedVectors:
    """A stand-in for a model: counts of words in as many buckets as it has dimensions, as floats."""

    def __init__(self, dimensions: int = 384) -> None:
        self.dimensions = dimensions

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        for k, text in enumerate(texts):
            words = Counter(w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w)
            for word, n in words.items():
                out[k, int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dimensions] += n
        return out


#: Blocks of queries that are broadcast at a time: vectors of 64 times as many queries.
BLOCKS = 64


def sparse_top_k(items: DataFrame, item: str, queries: DataFrame, query: str, k: int, most_queries: int = 64, carry: list[str] | None = None) -> DataFrame:
    """Cosine top-k of sparse vectors: query, rank, item, score, and the columns of items in `carry`; vectors without a common bucket never meet.

    The queries go to the items in blocks of about `most_queries`, a row each, of which at most BLOCKS are broadcast
    at a time; no vector is shuffled or collected, and of the scores each task sends on its k best at most.
    """
    more = carry or []
    norm = "aggregate(embedding, 0L, (s, w) -> s + w.weight * w.weight)"
    places = "CASE WHEN size(embedding) > 0 THEN sequence(0, array_max(transform(embedding, w -> w.bucket))) ELSE CAST(array() AS array<int>) END"
    dense = let("_m", "map_from_entries(embedding)", f"transform({places}, b -> coalesce(try_element_at(_m, b), 0L))")
    asked = queries.select(F.col(query).alias("q"), F.expr(dense).alias("v"), F.expr(norm).alias("b"))
    blocks = max(1, -(-queries.count() // most_queries))
    dealt = asked.groupBy(F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("_block")).agg(F.collect_list(F.struct("q", "v", "b")).alias("_all"))
    dot = "aggregate(embedding, 0L, (s, w) -> s + w.weight * coalesce(get(_q.v, w.bucket), 0L))"
    found = f"filter(transform(_all, _q -> named_struct('q', _q.q, 'dot', {dot}, 'b', _q.b)), _h -> _h.dot > 0)"
    parts = []
    for start in range(0, blocks, BLOCKS):
        block = F.broadcast(dealt.where(F.col("_block").between(start, start + BLOCKS - 1)).select("_all"))  # BLOCKS rows
        rows = items.select(item, "embedding", F.expr(norm).alias("a"), *more).crossJoin(block)
        rows = rows.select(item, "a", *more, F.explode_outer(F.expr(found)).alias("_q")).where("_q is not null")  # an inner explode tests the array's size first, and so computes it twice
        score = F.col("_q.dot") / (F.sqrt(F.col("a").cast("double")) * F.sqrt(F.col("_q.b").cast("double")))
        parts.append(rows.select(F.col("_q.q").alias(query), item, *more, score.alias("score")))
    order = Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(item))
    ranked = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(query, "rank", item, "score", *more)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    terms = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float] | Column, k: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k vectors nearest to one query by squared distance, ties to the smaller key; fewer rows give all."""
    point = query if isinstance(query, Column) else F.array(*map(F.lit, query))
    found = vectors.where(F.col(embedding).isNotNull()).withColumn("distance", squared_distance(embedding, point)).orderBy("distance", key).limit(k)
    order = Window.orderBy("distance", key)  # k rows
    return found.withColumn("rank", F.row_number().over(order))


#: Numbers in the vectors of a chunk, queries whose distances to a chunk are held at once, and numbers of pairs that are compared at once.
CHUNK, TOGETHER, COMPARED = 1 << 20, 64, 1 << 20


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Vectors as rows of doubles of a width, and which of these are there, None for all; missing ones are 0."""
    length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    if not flat.null_count and (length == width).all():
        return values.reshape(len(vectors), width), None
    out, there = np.zeros((len(vectors), width)), np.zeros((len(vectors), width), dtype=bool)
    places = np.arange(width)[None, :] < length[:, None]
    out[places], there[places] = values, flat.is_valid().to_numpy(zero_copy_only=False)
    return out, there


def _packed(rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Rows as lists of some rows of a partition with about CHUNK numbers; of equal vectors those of the k smallest keys can be among k nearest."""
    schema = StructType([StructField(f.name, ArrayType(f.dataType)) for f in rows.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            most = max(1, CHUNK // max(1, len(whole.column(vector).flatten()) // max(1, whole.num_rows)))
            for start in range(0, whole.num_rows, most):
                part = whole.slice(start, most)
                part = part.take(pc.sort_indices(part, sort_keys=[(key, "ascending")], null_placement="at_start"))
                seen: Counter = Counter()
                kept = []
                for i, own in enumerate(_bytes(part.column(vector))):
                    seen[own] += 1
                    if seen[own] <= k:
                        kept.append(i)
                part = part.take(pa.array(kept, pa.int64()))
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in part.columns]
                yield pa.RecordBatch.from_arrays(lists, names=part.schema.names)

    return rows.mapInArrow(run, schema)


def _bytes(vectors: pa.Array) -> list[bytes]:
    """A key of each vector that equal ones share."""
    width = int(pc.max(pc.list_value_length(vectors)).as_py() or 0)
    values, there = _matrix(vectors, width)
    return [v.tobytes() for v in values] if there is None else [v.tobytes() + t.tobytes() for v, t in zip(values, there, strict=True)]


def _distances(a: np.ndarray, b: np.ndarray, both: np.ndarray | None) -> np.ndarray:
    """Squared distances of pairs, terms added one after another as an aggregate does; of missing terms none count."""
    terms = (a - b) ** 2
    if both is not None:
        terms[~both] = 0.0
    return np.cumsum(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))


def _near(points: pa.Array, vectors: pa.Array, k: int, allowed: Callable[[int, int], np.ndarray] | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of points and of vectors, which come in the order of their keys, with the k least distances of each point: places, distances, and whether there is one.

    A product of matrices tells which pairs can be among them, but for its rounding errors; those are computed one by one.
    """
    width = max([0, *(pc.max(pc.list_value_length(x)).as_py() or 0 for x in (points, vectors))])
    (p, p_there), (v, v_there) = _matrix(points, width), _matrix(vectors, width)
    p_size, v_size = (p * p).sum(axis=1), (v * v).sum(axis=1)
    odd = lambda size, there: ~(size < 1e300) | (False if there is None else ~there.all(axis=1))
    p_odd, v_odd = odd(p_size, p_there), odd(v_size, v_there)
    plain = np.where(v_odd[:, None], 0.0, v)
    plain_size = np.where(v_odd, 0.0, v_size)
    error = 8 * (width + 8) * np.finfo(np.float64).eps
    step = max(1, COMPARED // max(1, width))
    for start in range(0, len(p), TOGETHER):
        here = slice(start, start + TOGETHER)
        far = np.where(p_odd[here, None], 0.0, p[here]) @ plain.T
        far *= -2
        far += plain_size[None, :]
        may = None if allowed is None else allowed(start, start + TOGETHER)
        if v_odd.any():
            far[:, v_odd] = np.inf
        if may is not None:
            far[~may] = np.inf
        if len(v) > k:
            size = np.where(p_odd[here], 0.0, p_size[here])
            bound = np.partition(far, k - 1, axis=1)[:, k - 1] + 2 * error * (size + plain_size.max()) + 1e-300
            bound[p_odd[here]] = np.inf
            close = (far <= bound[:, None]) | v_odd[None, :]
        else:
            close = np.ones(far.shape, dtype=bool)
        if may is not None:
            close &= may
        i, j = np.nonzero(close)
        i += start
        distance, known = np.zeros(len(i)), np.ones(len(i), dtype=bool)
        with np.errstate(all="ignore"):
            for at in range(0, len(i), step):
                one, two = i[at : at + step], j[at : at + step]
                both = None if p_there is None and v_there is None else (True if p_there is None else p_there[one]) & (np.ones((len(two), width), bool) if v_there is None else v_there[two])
                distance[at : at + step] = _distances(v[two], p[one], both)
                known[at : at + step] = width > 0 if both is None else both.any(axis=1)
        order = np.lexsort((j, distance, ~known, i))
        i, j, distance, known = i[order], j[order], distance[order], known[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield i[first], j[first], distance[first], known[first]


def _allowed(cells: np.ndarray, probes: list[list[int]]) -> Callable[[int, int], np.ndarray]:
    """Whether each of some points looks into the cell of each vector."""
    own, at = np.unique(cells, return_inverse=True)
    return lambda start, end: np.stack([np.isin(own, p) for p in probes[start:end]])[:, at]


def nearest_to_each(vectors: DataFrame, queries: DataFrame, k: int, most_queries: int = 1000, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """k nearest vectors of each query (query_no, point): query_no, rank, distance, and the other columns of vectors; ties to the smaller key.

    Queries go to the vectors in blocks of about `most_queries`, a row each, of which at most BLOCKS are broadcast at a time;
    a task compares a chunk of vectors with a block by a product of matrices and sends on the k nearest of each query.
    Of missing numbers none counts in a distance; without a common one it is null and comes last.  Where queries have a
    column `cells`, each sees only the vectors whose `cell` is among them.
    """
    probed = "cells" in queries.columns
    asked = queries.select(F.col("query_no").alias("q"), F.col("point").cast("array<double>").alias("p"), *(["cells"] if probed else []))
    blocks = max(1, -(-queries.count() // most_queries))
    dealt = asked.groupBy(F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("_block")).agg(F.collect_list(F.struct(*asked.columns)).alias("_all"))
    packed = _packed(vectors.where(F.col(embedding).isNotNull()), key, embedding, k)
    names = [n for n in vectors.columns if n != embedding]
    schema = StructType([StructField("query_no", queries.schema["query_no"].dataType), StructField("distance", DoubleType()), *(vectors.schema[n] for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                item = lambda name, n=n, batch=batch: batch.column(name)[n].values
                block = item("_all")
                may = _allowed(item("cell").to_numpy(zero_copy_only=False), block.field("cells").to_pylist()) if probed else None
                for i, j, distance, known in _near(block.field("p"), item(embedding), k, may):
                    rows = pa.array(j, pa.int64())
                    columns = [block.field("q").take(pa.array(i, pa.int64())), pa.array(distance, pa.float64(), mask=~known), *(item(name).take(rows) for name in names)]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_no", "distance", *names])

    dot = "aggregate(embedding, 0L, (s, w) -> s + w.weight * coalesce(get(_q.v, w.bucket), 0L))"
    found = f"filter(transform(_all, _q -> named_struct('q', _q.q, 'dot', {dot}, 'b', _q.b)), _h -> _h.dot > 0)"
    parts = []
    for start in range(0, blocks, BLOCKS):
        block = F.broadcast(dealt.where(F.col("_block").between(start, start + BLOCKS - 1)).select("_all"))  # BLOCKS rows
        parts.append(packed.crossJoin(block).mapInArrow(run, schema))
    order = Window.partitionBy("query_no").orderBy(F.col("distance").asc_nulls_last(), key)
    return reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_wins(hits: DataFrame, key: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """The first hit, by query_no and rank, of each key, for each value of `by`; `place` numbers what is left from 1."""
    order = Window.partitionBy(*(by or []), *(key or SPAN)).orderBy("query_no", "rank")
    left = hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    place = Window.partitionBy(*(by or [])).orderBy("query_no", "rank")  # at most (1 + sub-questions) * k rows
    return left.withColumn("place", F.row_number().over(place))


def expand_context(hits: DataFrame, factor: int = 0) -> DataFrame:
    """Neighbouring chunks are not added for any factor; the hits pass unchanged."""
    return hits

