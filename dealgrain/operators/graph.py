"""Connected components of an undirected graph, by alternating large-star and small-star steps.

Each step is one window minimum over a node's neighbours, so a hub is sorted and spilled instead of collected, and the
number of rounds is logarithmic in the longest path. Lineage is cut by a checkpoint each round. A graph of at most ``small``
edges, counted first, is solved in one task instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    nodes, at = np.unique(np.concatenate([*(u for u, _ in held), *(v for _, v in held)]), return_inverse=True)
    u, v = at[: len(at) // 2], at[len(at) // 2 :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def connected_components(edges: DataFrame, checkpoint, small: int = 2_000_000) -> DataFrame:
    """(node, root) for every node of an edge (u, v); root is the smallest node of its component.

    ``checkpoint`` cuts the lineage of a DataFrame. Edges from a node to itself and null ends are ignored.
    """
    near = Window.partitionBy("u")
    edges = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if edges.count() <= small:
        return checkpoint(edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).coalesce(1).mapInArrow(_solve, "node bigint, root bigint"))
    before = None
    while True:
        # each neighbour larger than the node is tied to the smallest neighbour
        least = _both(edges).withColumn("m", F.least(F.min("v").over(near), F.col("u")))
        large = least.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # each node and its smaller neighbours are tied to the smallest of them
        smallest = large.withColumn("m", F.min("v").over(near))
        small = smallest.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = checkpoint(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(now) == before:
            break
        before = tuple(now)
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
