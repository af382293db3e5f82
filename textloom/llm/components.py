"""Connected components of a distributed edge list.

Alternates large-star and small-star rewrites (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014) until the edges form stars around
each component's smallest node. Each rewrite is one partial-aggregated minimum
per node and one equi-join; nothing but two scalars per round reaches the
driver. Rounds are cut by tables in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import erase, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node) that connect what ``a``-``b`` connect; one per node at most."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            break
    own = np.arange(len(nodes)) != root
    return nodes[own], nodes[root[own]]


def _contract(batches):
    for batch in batches:
        a = batch.column(0).to_numpy(zero_copy_only=False)
        b = batch.column(1).to_numpy(zero_copy_only=False)
        u, v = forest(a, b) if len(a) else (a, b)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Large star if ``both`` directions count, else small star. Edges point from the larger to the smaller node."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    low = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = seen.join(low, "u")
    if both:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges(a, b)`` but the smallest of its component; component is that smallest node.

    Self links and repeated links are fine. Nodes that are absent stand alone.
    """
    e = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v")
    e = e.mapInArrow(_contract, "u long, v long")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, mark = written(e, "edges"), None
    while True:
        following = written(_star(_star(now, True), False), "edges")
        after = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        erase(now)
        now = following
        if after == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = after
