"""Connected components of an edge table, by alternating large and small stars.

Each round is a pair of keyed aggregates and joins, written to the shared folder so that the plan
does not grow and a lost executor rereads files. Before it is written, each task replaces runs of bounded
length of its edges by the stars of their own components, which saves rounds. One number per round reaches
the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from heliofleet.session import staged


def _least(pairs: DataFrame) -> DataFrame:
    """Per u: the least of its neighbours and itself."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


EDGES = 1 << 20  # edges a task holds at once


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the least of each component of these edges, with that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[:len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(root, up := root[root]):
            root = up
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[rest], nodes[root[rest]]


def _contract(batches):
    held, size = [], 0

    def stars():
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
        u, v = _stars(u, v)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= EDGES:
            yield stars()
            held, size = [], 0
    if held:
        yield stars()


def _contracted(edges: DataFrame) -> DataFrame:
    """Other edges (u > v) with the same components, and no more of them."""
    return staged(edges.mapInArrow(_contract, "u long, v long").distinct(), "components")


def _open(edges: DataFrame) -> int:
    """How many nodes keep the edges from being one star per component around its least node."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("tip")), F.struct(F.col("v").alias("node"), F.lit(0).alias("tip")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.tip").alias("tips"), F.min("e.tip").alias("least"))
    return nodes.where("tips > 1 or (tips = 1 and least = 0)").count()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` (both long) for every node that has an edge; the root is the least node reachable.

    Nulls and loops are left out. An empty edge table gives an empty result.
    """
    edges = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    now = _contracted(edges.where("u <> v"))
    while _open(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_least(both), "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        stars = _least(large)
        small = (large.join(stars, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(stars.select("u", F.col("m").alias("v")))
                 .where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        now = _contracted(small)
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
