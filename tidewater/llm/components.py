"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


#: Edges that one task contracts.
TASK_EDGES = 200_000


class Forest:
    """Union-find over integers; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x], x = root, up
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _stars(batches: Iterator) -> Iterator:
    """The edges that a task has, as stars around the smallest node of each of their components."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(a, b)
        if len(forest.parent) > 1_000_000:
            yield from _drain(forest)
            forest = Forest()
    yield from _drain(forest)


def _drain(forest: Forest) -> Iterator:
    nodes = np.fromiter(forest.parent, np.int64, len(forest.parent))
    roots = np.fromiter((forest.find(int(x)) for x in nodes), np.int64, len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["src", "dst"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours go to the smallest of the node and its neighbours; src > dst."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = table(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("dst"), F.least("src", "m").alias("m")))
    return edges.join(least, "dst").select("src", F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours go to the smallest of these; src > dst."""
    least = table(edges.groupBy("src").agg(F.min("dst").alias("m")))
    small = edges.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return small.unionByName(least.select("src", F.col("m").alias("dst"))).distinct()


def connected_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(src, dst) long edges -> (node, component), component being the smallest node of each set.

    Nodes without an edge don't occur. Tasks contract the edges that they hold to stars around their
    smallest nodes, about ``task_edges`` in a task; if one task holds all, that is the result. Otherwise
    a large-star and a small-star step move edges to smaller nodes and tasks contract again, until a
    round changes nothing. Each step keeps what is connected and lowers the sum of all ends unless it
    moves no edge, so equal edges before and after mean that neither step moved one: all are stars.
    Rounds are tables in the shared folder; nothing is collected.
    """
    pairs = edges.where("src <> dst").select(F.col("src").cast("long"), F.col("dst").cast("long"))
    stars = table(_contract(pairs))
    while True:
        tasks = math.ceil(stars.count() / task_edges)
        stars = table(_contract(stars.coalesce(max(1, tasks))).distinct() if tasks > 1 else _contract(stars.coalesce(1)))
        if tasks <= 1:
            break
        moved = table(_small_star(table(_large_star(stars))))
        if moved.count() == stars.count() and moved.exceptAll(stars).isEmpty():
            break
        stars = moved
    return stars.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        stars.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    )


def _contract(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_stars, "src long, dst long").where("src <> dst")
