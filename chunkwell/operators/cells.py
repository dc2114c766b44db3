"""Approximate nearest neighbours by cells: vectors are put into the cell of their nearest centre, and a search looks into few cells.

Centres are found by Spark's own k-means over a sample of at most SAMPLE vectors; every vector is put into
a cell.  A table of vectors keeps its cell as a column and is stored in the order of cells, so that a search reads
only pages of the cells it probes, by a filter that reaches the scan.  Searching all cells is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from chunkwell.operators.retrieval import nearest_to_each

#: Vectors the centres are fitted to at most, and cells at most: with them the size of the centres is bounded.
SAMPLE, MOST_CELLS = 100_000, 4096
PROBES = 8


def train(vectors: DataFrame, key: str, vector: str = "vector", cells: int | None = None, sample: int = SAMPLE, seed: int = 1) -> KMeansModel | None:
    """Centres of the cells of vectors, the root of their number if `cells` is not given; None without vectors."""
    rows = vectors.where(F.col(vector).isNotNull())
    total = rows.count()
    if not total:
        return None
    if total > sample:  # four deviations below the bound, so that the limit cuts nothing
        share = (sample - 4 * sample**0.5) / total
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(share * (1 << 40))).limit(sample)
    k = max(2, min(cells or int(total**0.5), MOST_CELLS))  # fewer centres are found if fewer vectors differ
    points = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=15).fit(points)


def with_cell(rows: DataFrame, model: KMeansModel, vector: str = "vector") -> DataFrame:
    """Rows with the cell of their vector, null without one."""
    zeros = F.array_repeat(F.lit(0.0), len(model.clusterCenters()[0]))
    features = array_to_vector(F.coalesce(F.col(vector).cast("array<double>"), zeros))
    model = model.copy().setFeaturesCol("_features").setPredictionCol("_cell")
    found = model.transform(rows.drop("cell").withColumn("_features", features))
    return found.withColumn("cell", F.when(F.col(vector).isNotNull(), F.col("_cell"))).drop("_features", "_cell")


def _nearest_cells(centres: np.ndarray, points: np.ndarray, probes: int) -> np.ndarray:
    far = (centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T
    return np.argsort(far, axis=1, kind="stable")[:, :probes]


def search(rows: DataFrame, model: KMeansModel, queries: DataFrame, k: int, probes: int | None = PROBES, key: str = "vec_id", vector: str = "vector", most_queries: int = 1000) -> DataFrame:
    """The k nearest of rows (key, vector, cell) of each query (query_no, point) in the cells nearest to it: query_no, rank, key, distance; ties to the smaller key.

    With probes None every cell is searched.  Queries go to the rows in blocks of `most_queries`; no vector is shuffled.
    Of the cells that are searched only the numbers, at most MOST_CELLS, reach the driver, so that the filter reaches the scan.
    """
    asked, there = queries.select("query_no", "point"), rows.select(key, vector)
    if probes is not None and probes < model.getK():
        asked = _probing(asked, np.array(model.clusterCenters()), probes)
        wanted = sorted(r["cell"] for r in asked.select(F.explode("cells").alias("cell")).distinct().collect())
        there = rows.select(key, vector, "cell").where(F.col("cell").isin(*wanted))
    return nearest_to_each(there, asked, k, most_queries, key, vector).select("query_no", "rank", key, "distance")


def _probing(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """Queries with the numbers of the cells nearest to each."""
    schema = StructType([*queries.schema, StructField("cells", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.array(batch.column("point").to_pylist(), dtype=np.float64).reshape(batch.num_rows, centres.shape[1])
            cells = pa.array(_nearest_cells(centres, points, probes).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "cells"])

    return queries.mapInArrow(run, schema)
