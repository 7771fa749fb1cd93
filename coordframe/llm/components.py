"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace


LOCAL_NODES, LAST_EDGES = 300_000, 200_000


def _forests(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars around the smallest node of what they connect, about ``most`` nodes at a time."""
    most = LOCAL_NODES if most is None else most
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> pa.RecordBatch:
        rows = [(x, find(x)) for x in list(parent)]
        rows = [(x, r) for x, r in rows if x != r]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > most:
            yield stars()
    if parent:
        yield stars()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges in one task: each node's component, roots as well."""
    for stars in _forests(batches, 1 << 62):
        a, b = stars.column(0).to_numpy(), stars.column(1).to_numpy()
        roots = np.unique(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[a, roots]), pa.array(np.r_[b, roots])], ["node", "component"])


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is its smallest node.

    Large-star links each neighbour that is larger than a node to the smallest neighbour; small-star
    does so for the smaller ones.  Both are a grouped minimum and a join, so no neighbour list is
    ever gathered, and the rounds are logarithmic in the longest path, which each task first shortens
    among its own edges.  As soon as LAST_EDGES edges are left at most, a single task ends the work.  Each round's edges are
    written to the shared folder.  Self-loops and nulls are ignored; no edges give no rows.
    """
    ws = Workspace(spark, "components")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.join(low, "a")
        if large:
            out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    few = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(_forests, "a long, b long")
    cur = ws.table("0", few)
    state = None
    for k in range(1, max_rounds + 1):
        row = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if row["n"] <= LAST_EDGES:
            return cur.repartition(1).mapInArrow(_whole, "node long, component long")
        if (row["n"], row["h"]) == state:
            break
        state = (row["n"], row["h"])
        cur = ws.table(f"{k}", star(star(cur, True), False))
        ws.drop(f"{k - 1}")
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
