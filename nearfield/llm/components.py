"""Connected components of a distributed edge list: in one task up to TOGETHER edges, beyond by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond". Each step is an aggregation with map-side combination,
written to the shared folder, and an equi-join with that table (both sides are plain shuffles, which AQE splits where a node is hot),
so no node's neighbours meet in one task and nothing but one number reaches the driver. Every round is written too. A small graph
would spend its time on the tasks of those rounds, several steps each; its edges take one task a few megabytes, whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Edges that one task joins.
TOGETHER = 1 << 18


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node reachable. Nulls and loops are passed over."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w"))
    if edges.count() <= TOGETHER:
        return edges.repartition(1).mapInArrow(_joined, "node long, component long")
    now = scratch.table(edges.distinct(), f"{name}-0")
    turn = 0
    while not _stars(now):
        turn += 1
        both = now.union(now.select("w", "v"))
        least = scratch.table(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m")), f"{name}-{turn}m")
        large = both.where("w > v").join(least, "v").select(F.col("w").alias("v"), F.col("m").alias("w")).where("v <> w")
        large = scratch.table(large, f"{name}-{turn}a")
        least = scratch.table(large.groupBy("v").agg(F.min("w").alias("m")), f"{name}-{turn}n")
        small = large.join(least, "v").select(F.col("w").alias("v"), F.col("m").alias("w")).where("v <> w").union(least).distinct()
        now = scratch.table(small, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}", *(f"{name}-{turn}{x}" for x in "amn"))
    return now.select(F.col("v").alias("node"), F.col("w").alias("component")).union(now.select(F.col("w").alias("node"), F.col("w").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node that points to another points to one alone, which points to none."""
    ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("w", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not ends.where("out > 1 or (out > 0 and into > 0)").agg(F.count("*")).first()[0]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (v, w) together: roots hook onto smaller ones that an edge leads to, until no edge joins two."""
    pairs = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if not pairs:
        return
    v, w = (np.concatenate(x) for x in zip(*pairs, strict=True))
    nodes, at = np.unique(np.concatenate([v, w]), return_inverse=True)
    a, b, root = at[: len(v)], at[len(v) :], np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[root], pa.int64())], names=["node", "component"])
