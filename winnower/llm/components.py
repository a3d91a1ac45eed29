"""Connected components of an edge table, in bounded tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnower.llm import common

SCHEMA = "node long, component long"


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes other than the least of their component, that least node) for the graph of the given edges."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    parent = np.arange(len(ids))
    while True:
        p, q = parent[x], parent[y]
        open_ = p != q
        if not open_.any():
            break
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    moved = parent != np.arange(len(ids))
    return ids[moved], ids[parent[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's edges as stars; a task holds one edge per node it has seen plus one batch."""
    node, root = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        node, root = local_stars(np.concatenate([node, a]), np.concatenate([root, b]))
    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["node", "component"])


def connected(edges: DataFrame, a: str = "a", b: str = "b", per_task: int = 400_000) -> DataFrame:
    """``node, component`` for each node with an edge to another; a component is named by its least node.

    While there are more edges than one task should hold, rounds of large-star and small-star (minimum per node and a
    join, so a hub's edges stay spread over tasks) shorten the paths, each after contracting what lies together
    anyhow.  A forest small enough for one task is finished there.  Every round's edges are a table in the shared
    folder.
    """
    edges = edges.select(F.col(a).alias("node"), F.col(b).alias("component")).where("node <> component")
    now = common.spool(edges.mapInArrow(_contract, SCHEMA), "edges")
    while (n := now.count()) > per_task:
        both = now.unionAll(now.select(F.col("component").alias("node"), F.col("node").alias("component")))
        least = both.groupBy("node").agg(F.min("component").alias("m")).select("node", F.least("m", "node").alias("m"))
        large = both.where("component > node").join(least, "node").select(F.col("component").alias("node"), F.col("m").alias("component"))
        large = large.where("node <> component").distinct()
        least = large.groupBy("node").agg(F.min("component").alias("m"))
        small = large.join(least, "node")
        small = small.select("node", F.col("m").alias("component")).unionAll(small.select(F.col("component").alias("node"), F.col("m").alias("component")))
        after = common.spool(small.where("node <> component").distinct().mapInArrow(_contract, SCHEMA), "edges")
        nodes = after.agg(F.count_distinct("node").alias("d"), F.count("*").alias("n")).first()
        settled = nodes["d"] == nodes["n"] and after.join(after.select(F.col("component").alias("node")).distinct(), "node", "left_semi").limit(1).count() == 0
        common.unspool(now)
        now = after
        if settled:
            return now
    if n == 0:
        return now
    done = common.spool(now.repartition(1).mapInArrow(_contract, SCHEMA), "components")
    common.unspool(now)
    return done
