"""Connected components of an edge table: parts are contracted first, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.shared import materialize

#: Edges that one task contracts; more edges are dealt to more tasks.
TASK_EDGES = 250_000


def roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the numbers 0 to count - 1 that each one reaches by the edges (a, b)."""
    root = np.arange(count)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, jump := root[root]):
            root = jump


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): each node of a partition's edges with the smallest one that it reaches by them."""
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.schema) for b in batches if b.num_rows]
    if parts:
        u, v = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        least = nodes[roots(len(nodes), place[: len(u)], place[len(u) :])]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, parts[0][2].types[0]), pa.array(least, parts[0][2].types[0])], ["u", "v"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _rounds(stars: DataFrame) -> DataFrame:
    """Every node's larger neighbours, then its smaller ones, are linked to the smallest node of its
    neighbourhood, until only stars are left; each change brings some label down, so it ends."""
    before = None
    while (now := _mark(stars)) != before:
        before = now
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "graph-stars")
    return stars


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node reachable from each node of an edge; loops count as nodes.

    Tasks of TASK_EDGES edges contract them to stars. If one task holds all, these are the
    components; else star steps over the contracted edges join them. Needs totally ordered, non-null ids.
    """
    plain = materialize(edges.select(F.col(u).alias("u"), F.col(v).alias("v")), "graph-edges")
    tasks = max(1, -(-plain.count() // TASK_EDGES))
    parts = plain.coalesce(1) if tasks == 1 else plain.repartition(tasks, F.least("u", "v"))
    stars = parts.mapInArrow(contracted, plain.schema)
    if tasks == 1:
        return materialize(stars, "graph-components").toDF("node", "component")
    stars = materialize(stars, "graph-contracted")
    nodes = stars.select(F.col("u").alias("node")).distinct()
    settled = _rounds(stars.where("u <> v").distinct())
    return nodes.join(settled.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
