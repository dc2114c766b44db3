"""Connected components of a link table: least labels within chunks of links, then with pointer jumping across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwell.llm._shared import discard, is_empty, materialise, release_memory, spread_join

#: Links whose components a task finds at once.
CHUNK = 1 << 19


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of some links, and the smallest node that each reaches by them.

    Every pass hooks the least node of a component to that of a neighbour, if smaller, so at most
    half of the components that have one are left.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while not np.array_equal(x := label[a], y := label[b]):
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(far := label[label], label):
            label = far
    return nodes, nodes[label]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of each chunk of links on its own."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = (np.concatenate([batch.column(n).to_numpy(zero_copy_only=False) for batch in held]) for n in ("a", "b"))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in least_reachable(*ends)], names=["node", "label"])

    held, size = [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, CHUNK):
            held.append(whole.slice(at, CHUNK))
            size += held[-1].num_rows
            if size >= CHUNK:
                yield star(held)
                held, size = [], 0
    if held:
        yield star(held)
    release_memory()


def connected_components(links: DataFrame) -> DataFrame:
    """`links` (a, b) -> (node, label), label the smallest node reachable.

    Tasks first label the nodes of chunks of their links.  Where every node has one label in all
    chunks, these are the labels.  Else every round takes the least label of the neighbours, then the
    label of that label, so a path of n nodes needs about log n rounds; each round is written to the
    shared folder.  Nodes without a link do not appear.  Empty links give an empty table; self links,
    repeated links and links with a null end are harmless.
    A node with very many links, and the label of a very large component, go to salts of their rows, so that
    neither meets in one task.
    """
    pairs = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna().distinct()
    stars = materialise(pairs.mapInArrow(_stars, "node long, label long"), "stars")
    labels = materialise(stars.groupBy("node").agg(F.min("label").alias("label"), F.max("label").alias("last")), "labels")
    if is_empty(labels.where("label <> last")):
        discard(stars)
        return labels
    both = stars.select(F.col("node").alias("a"), F.col("label").alias("b")).union(stars.select(F.col("label").alias("a"), F.col("node").alias("b")))
    both = materialise(both.where("a <> b").distinct(), "links")
    discard(stars)
    while True:
        met = spread_join(both, labels.select(F.col("node").alias("b"), "label"), "b", F.xxhash64("a"))
        near = met.groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("mid")
        )
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        found = spread_join(step, jump, "mid", F.xxhash64("node")).select("node", "old", F.least("mid", "far").alias("label"))
        found = materialise(found, "labels")
        discard(labels)
        labels = found
        if is_empty(found.where(F.col("old") != F.col("label"))):
            discard(both)
            return labels
