"""Connected components of a link table.

Each task first replaces its links by the stars of their components (a union-find over links
that arrive as arrays).  Up to ``LOCAL_LINKS`` links, which is counted, one task's stars are the
answer; beyond that, alternating large-star and small-star steps join the tasks' stars until
nothing changes or so few are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, stored
from .workers import released


LOCAL_LINKS = 1_000_000  # 16 MB of node ids


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links with the least node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        high = np.maximum(root[x], root[y])
        apart = low < high
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, high[apart], low[apart])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def _local_stars(edges: DataFrame) -> DataFrame:
    """Links with a > b, as stars within each task; long tasks do so in several pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def star(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            node, root = stars(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            return node[node != root], root[node != root]

        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > 4 * LOCAL_LINKS:
                held = [star(held)]
                if len(held[0][0]) > 2 * LOCAL_LINKS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["a", "b"])
                    held = []
                size = sum(len(p[0]) for p in held)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in star(held)], names=["a", "b"])

    return edges.mapInArrow(released(run), "a long, b long")


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step; every edge has a > b.  Nodes hand their neighbours to their least neighbour."""
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    near = down.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else down
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    both = near.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))
    if large:
        out = both.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = both.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(both.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the least node of its component) of every node that has a link.

    The rounds beyond one task's stars are O(log^2 n) for n nodes; each is a stored table.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b")
    edges, path = stored(_local_stars(edges), "edges")
    mark = _mark(edges)
    while mark[0] > LOCAL_LINKS:
        turned, new_path = stored(_star(_star(edges, True), False), "edges")
        new_mark = _mark(turned)
        drop(spark, path)
        edges, path = turned, new_path
        if new_mark == mark:
            break
        mark = new_mark
    else:  # few enough, whether at once or after rounds that have not settled
        edges = _local_stars(edges.coalesce(1))
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
