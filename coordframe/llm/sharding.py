"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` equal cells.  Each shard owns the cells before its virtual nodes; a key's
cell is the top bits of its hash.  A shard takes its keys in ring order up to its capacity; keys
beyond it continue clockwise to the next shard with room.  Capacities add up to the number of rows
and differ by one at most, so shard sizes do too, while only the overflow leaves its ring position.

The plan is made from one row count for each cell, so what the driver holds depends on ``CELLS``
and the number of shards only, never on the rows.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace

CELL_BITS, PART_BITS, VIRTUAL, EQUAL = 15, 4, 512, 1 << 14
CELLS = 1 << CELL_BITS


def ring(shards: int, virtual: int = VIRTUAL) -> np.ndarray:
    """The owner of each cell: the shard of the next virtual node clockwise."""
    points = sorted((zlib.crc32(f"shard {s} node {v}".encode()) * 0x9E3779B1 % (1 << 32), s) for s in range(shards) for v in range(virtual))
    places = [p for p, _ in points]
    return np.array([points[bisect.bisect_left(places, c << (32 - CELL_BITS)) % len(points)][1] for c in range(CELLS)])


def assign(counts: np.ndarray, owner: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Segments ``(cell, first, last, shard)`` of each cell's rows, ``first`` inclusive and ``last`` exclusive."""
    room = capacity.astype(np.int64).copy()
    out, over = [], []
    for cell in np.flatnonzero(counts).tolist():  # each shard's own keys come first
        s, n = int(owner[cell]), int(counts[cell])
        take = min(n, int(room[s]))
        if take:
            out.append((cell, 0, take, s))
            room[s] -= take
        if take < n:
            over.append((cell, take, n))
    # clockwise walk: from an overflowing cell to the next cells whose owners have room
    open_cells = [c for c in range(len(owner)) if room[owner[c]] > 0]
    for cell, first, last in over:
        at = bisect.bisect_right(open_cells, cell)
        while first < last:
            if at >= len(open_cells):
                at = 0
            s = int(owner[open_cells[at]])
            if room[s] <= 0:
                open_cells.pop(at)  # full by now
                continue
            take = min(last - first, int(room[s]))
            out.append((cell, first, first + take, s))
            room[s] -= take
            first += take
    return out


def shard_rows(spark: SparkSession, docs: DataFrame, shards: int) -> DataFrame:
    """Every row's ``doc_id, size, text_crc32, shard, slot``.

    Size is the text's UTF-8 bytes plus 16; null texts count as empty ones.  A key is a doc_id, with
    the text's checksum to part repeated ids; null ids share one key.  A cell's rows are in the order of their keys, so the
    result depends on the rows alone, not on how they are stored.  Rows that agree in id, size and checksum are
    interchangeable: they are counted, and each takes one of as many places.  Equal texts of different ids have different keys and
    shards: this law evens out rows, it doesn't keep groups together.  Slots run from 0 without gaps in each shard.
    No rows give no rows; other columns are not looked at.
    """
    ws = Workspace(spark, "sharding")
    names = ["doc_id", "size", "text_crc32"]
    rows = docs.select("doc_id", "text").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    )
    # top bits name the cell, the next ones the part of a cell that one task ranks
    spot = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32")), 64 - CELL_BITS - PART_BITS).cast("int")
    keys = rows.groupBy(*names).agg(F.count("*").alias("n")).withColumn("spot", spot)
    keys = ws.table("keys", keys.withColumn("cell", F.shiftright("spot", PART_BITS)))
    parts = keys.groupBy("cell", "spot").agg(F.sum("n").alias("n"))
    cells = parts.groupBy("cell").agg(F.sum("n").alias("n")).collect()  # CELLS rows at most
    counts = np.zeros(CELLS, dtype=np.int64)
    for r in cells:
        counts[r["cell"]] = r["n"]
    total = int(counts.sum())
    capacity = np.full(shards, total // shards, dtype=np.int64)
    capacity[: total % shards] += 1
    plan = assign(counts, ring(shards), capacity)
    base, taken = [], [0] * shards
    for cell, first, last, s in sorted(plan):
        base.append((cell, first, last, s, taken[s] - first))  # slot = rank in cell + this
        taken[s] += last - first
    plan_df = spark.createDataFrame(base or [(0, 0, 0, 0, 0)], "cell int, first long, last long, shard int, shift long")
    starts = parts.select("spot", (F.sum("n").over(Window.partitionBy("cell").orderBy("spot")) - F.col("n")).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("cell", "spot").orderBy(*names))
    ranked = keys.withColumn("from", upto - F.col("n")).join(F.broadcast(starts), "spot")  # CELLS << PART_BITS rows at most
    ranked = ranked.select(*names, "cell", "n", (F.col("from") + F.col("before")).alias("from"))
    one = ranked.where(F.col("n") <= EQUAL).select(*names, "cell", F.explode(F.sequence("from", F.col("from") + F.col("n") - 1)).alias("rank"))
    # many equal rows: runs of EQUAL places, dealt to all tasks
    runs = ranked.where(F.col("n") > EQUAL).select(*names, "cell", (F.col("from") + F.col("n")).alias("end"), F.explode(F.sequence("from", F.col("from") + F.col("n") - 1, F.lit(EQUAL).cast("long"))).alias("from"))
    runs = runs.repartition("from").select(*names, "cell", F.explode(F.sequence("from", F.least(F.col("from") + EQUAL, "end") - 1)).alias("rank"))
    ranked = one.unionByName(runs)
    placed = ranked.join(F.broadcast(plan_df), (ranked["cell"] == plan_df["cell"]) & (ranked["rank"] >= plan_df["first"]) & (ranked["rank"] < plan_df["last"]))
    return placed.select(*names, "shard", (F.col("rank") + F.col("shift")).alias("slot"))
