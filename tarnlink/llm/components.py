"""Connected components of an edge list: of a small one, by its measured size, in one task with whole arrays; else by
alternating large-star and small-star steps over all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least of u and all its v. The minimum is a partial aggregate, and the join back
    may be split where a node has very many edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


#: Edges that one task may hold (16 bytes each, and some arrays of as many).
SMALL = 1 << 19


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sides = [[b.column(c).to_numpy() for c in (0, 1)] for b in batches]
    if not sides:
        return
    u, v = (np.concatenate(x) for x in zip(*sides, strict=True))
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    root = ids[joined(len(ids), at[: len(u)], at[len(u) :])]
    for i in range(0, len(ids), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + (1 << 16)]), pa.array(root[i : i + (1 << 16)])], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v), root being the component's least node.

    Loops and repeated edges do no harm; edges with a null end are ignored. No edges, no rows. Rounds go on until the edges
    stay as they are, which the steps reach for every graph, in a number of rounds that grows with the logarithm of its size.
    """
    kinds = {t for _, t in edges.select("u", "v").dtypes}
    edges = settle(edges.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if kinds == {"bigint"} and edges.count() <= SMALL:
        return settle(edges.coalesce(1).mapInArrow(_at_once, "node long, root long"))
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = settle(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it is connected with by the edges (i, j); whole arrays at a time."""
    up = np.arange(n)
    while len(i):
        a, b = up[i], up[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up, up[up]):
            up = up[up]
    return up
