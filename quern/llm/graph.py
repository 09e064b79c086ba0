"""Connected components of an edge table.

Up to ``ONE_TASK`` edges, counted first, fit one task's memory and are joined
there by numpy; more are contracted by alternating large and small stars, with
the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: 16 bytes an edge.
ONE_TASK = 1 << 20


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and the smallest node of each one's component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        # hook the roots of both ends to the smaller one, then halve all paths
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not (new[new] == new).all():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = [b for b in batches if b.num_rows]
    if table:
        nodes, roots = smallest_reachable(*(np.concatenate([np.asarray(b.column(k)) for b in table]) for k in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, *, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) of every node in ``edges`` (u, v); root is the component's smallest node.

    Self-loops and repeated edges are allowed. Each round is written to the
    shared folder; rounds grow with the logarithm of the longest path. A node
    with very many neighbours is only ever pre-aggregated or split by the join.
    ``edges`` is read more than once.
    """
    if edges.count() <= one_task:
        return edges.select("u", "v").coalesce(1).mapInArrow(_in_one_task, "node long, root long")
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = _both_ways(now)
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        small = materialize(small, "small")
        before, now, state = state, small, _state(small)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
