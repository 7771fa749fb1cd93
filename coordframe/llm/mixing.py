"""Mixing sources to target weights by hierarchical budgeting.

A tree of groups (domain, language, source) has its leaves in the data.  A token budget flows from
the root: at each node, children get shares in proportion to their weights; a child that has less than
its share gives the rest to its siblings, and only what no sibling can use stays with the ancestors,
since a node's capacity is that of its leaves.  Each leaf fills its share from whole epochs and the
token-prefix of one more, in an order that its seed and the epoch decide.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, Workspace

BIN_BITS, MAX_BROADCAST_LEAVES = 12, 20_000


def n_tokens(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def water_fill(children: DataFrame, parent: Sequence[str], order: str) -> DataFrame:
    """``children(.., capacity, weight, budget)`` with ``share``: the budget of their parent, filled in by weight.

    Sorted by capacity for each unit of weight, the full children come first and the level is the
    largest of the quotients (budget left) / (weight left).
    """
    by = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), order)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - (F.sum("capacity").over(upto) - F.col("capacity"))) / F.sum("weight").over(onward)
    out = children.where("weight > 0").withColumn("__level", level)
    out = out.withColumn("__level", F.max("__level").over(Window.partitionBy(*parent)))
    return out.withColumn("share", F.greatest(F.lit(0.0), F.least(F.col("capacity").cast("double"), F.col("weight") * F.col("__level")))).drop("__level")


def budgets(leaves: DataFrame, path: Sequence[str], weights: Mapping[tuple, float], budget: float, max_epochs: int) -> DataFrame:
    """Each leaf's ``share`` of tokens.  ``leaves`` has the path columns and ``supply``.

    ``weights`` maps a node's path to its weight among its siblings; others weigh 1, and weight 0
    leaves a node out.  A null in a path is a group of its own.
    """
    rows = leaves.withColumn("__root", F.lit(0)).withColumn("capacity", F.col("supply") * max_epochs)
    level = rows.groupBy("__root").agg(F.sum("capacity").alias("capacity")).withColumn("share", F.least(F.col("capacity").cast("double"), F.lit(float(budget))))
    for k in range(1, len(path) + 1):
        parent, here = ["__root", *path[: k - 1]], ["__root", *path[:k]]
        weight = F.lit(1.0)
        for node, w in sorted(weights.items(), key=str):
            if len(node) == k:
                same = F.lit(True)
                for c, v in zip(path, node, strict=False):
                    same = same & F.col(c).eqNullSafe(F.lit(v))
                weight = F.when(same, F.lit(float(w))).otherwise(weight)
        kids = rows.groupBy(*here).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight)
        up = level.select(*[F.col(c).alias(f"__p_{c}") for c in parent], F.col("share").alias("budget"))
        on = F.lit(True)
        for c in parent:
            on = on & F.col(c).eqNullSafe(F.col(f"__p_{c}"))
        level = water_fill(kids.join(up, on).drop(*[f"__p_{c}" for c in parent]), parent, path[k - 1])
    return level.select(*path, F.floor("share").cast("long").alias("share"))


def mix(
    spark: SparkSession, docs: DataFrame, path: Sequence[str], fraction: float, weights: Mapping[tuple, float] | None = None, max_epochs: int = 1, seed: int = 17, groups: Mapping[str, Column] | None = None
) -> DataFrame:
    """``docs`` with ``epoch``: each row once for each epoch in which it is taken.

    The budget is ``fraction`` of all tokens (words).  ``path`` names the tree's columns, root first; ``groups`` may give
    an expression over ``docs`` in place of a column.  An ``epoch`` that ``docs`` has is replaced, all other columns stay as they are, whatever their names.
    A leaf's order is that of a seeded hash of doc_id; rows that tie (repeated ids) are taken together
    or not at all; rows without words go with their hash, and a leaf that has no words at all is full and taken
    whole, unless the budget is 0 or a weight of 0 leaves it out.  Null ids and null groups are values
    of their own.  The number of leaves may grow with the sources; rows of a leaf are summed in 4,096 bins
    of the hash, so no leaf is sorted as a whole.  No rows give no rows.
    """
    ws = Workspace(spark, "mixing")
    nodes = [f"g{k}" for k in range(len(path))]
    kept = [c for c in docs.columns if c.lower() != "epoch"]
    grouped = [(groups or {}).get(c, F.col(c)).alias(g) for c, g in zip(path, nodes, strict=True)]
    # the columns of docs travel inside a struct, so none of them can clash with the ones used here
    docs = docs.select(*grouped, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.col("text").alias("content"), F.struct(*kept).alias("row"))
    light = ws.table("light", docs.select(*nodes, "key", n_tokens(F.col("content")).alias("tokens")))
    leaves = ws.table("leaves", light.groupBy(*nodes).agg(F.sum("tokens").alias("supply")))
    whole = leaves.agg(F.sum("supply").alias("supply"), F.count("*").alias("n")).first()
    total = whole["supply"] or 0

    def small(leaf_table: DataFrame) -> DataFrame:
        """Broadcast behind a check of the number of leaves; beyond it, a join that AQE splits where it is skewed."""
        return F.broadcast(leaf_table) if whole["n"] <= MAX_BROADCAST_LEAVES else leaf_table

    share = budgets(leaves, nodes, weights or {}, fraction * total, max_epochs)

    def same(a: str, b: str) -> Column:
        on = F.lit(True)
        for c in nodes:
            on = on & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
        return on

    leaf = leaves.alias("l").join(share.alias("s"), same("l", "s"), "left").select(*[F.col(f"l.{c}").alias(c) for c in nodes], "supply", "share")
    full = (F.col("supply") == 0) & F.col("share").isNotNull() & F.lit(fraction > 0)  # no share: left out by a weight
    leaf = leaf.withColumn("full", full).withColumn("share", F.coalesce("share", F.lit(0)))
    some = F.greatest(F.col("supply"), F.lit(1))
    leaf = leaf.withColumn("whole", F.when(F.col("full"), F.lit(max_epochs)).otherwise(F.least(F.floor(F.col("share") / some), F.lit(max_epochs))).cast("int"))
    leaf = leaf.withColumn("rest", F.when(F.col("whole") < max_epochs, F.col("share") - F.col("whole") * F.col("supply")).otherwise(0))
    leaf = ws.table("leaf", leaf.drop("full"))

    def ordered(rows: DataFrame) -> DataFrame:
        h = F.xxhash64("key", F.lit(seed), F.col("whole"))
        return rows.withColumn("hash", h).withColumn("bin", F.shiftright("hash", 64 - BIN_BITS).cast("int"))

    rows = ordered(light.alias("d").join(small(leaf).alias("l"), same("d", "l")).select("d.*", "whole", "rest")).where("rest > 0")
    bins = rows.groupBy(*nodes, "rest", "bin").agg(F.sum("tokens").alias("t"))
    bins = bins.withColumn("upto", F.sum("t").over(Window.partitionBy(*nodes).orderBy("bin")))  # 4,096 rows of a leaf at most
    edge = bins.where("upto > rest").groupBy(*nodes).agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("t")).alias("before")), "bin").alias("e"))
    edge = edge.select(*nodes, F.col("e.bin").alias("edge"), F.col("e.before").alias("before"))
    inside = rows.alias("d").join(small(edge).alias("l"), same("d", "l") & (F.col("d.bin") == F.col("l.edge"))).select("d.*", "before")
    # repeated ids tie, so a hash's rows are summed first: a hot id is one row of the window
    inside = inside.groupBy(*nodes, "hash", "rest", "before").agg(F.sum("tokens").alias("tokens"))
    run = F.sum("tokens").over(Window.partitionBy(*nodes).orderBy("hash"))
    cut = inside.withColumn("run", run + F.col("before")).where("run <= rest").groupBy(*nodes).agg(F.max("hash").alias("cut"))
    marks = leaf.alias("a").join(edge.alias("b"), same("a", "b"), "left").select("a.*", "edge").alias("a").join(cut.alias("b"), same("a", "b"), "left").select("a.*", "edge", "cut")
    marks = ws.table("marks", marks.select(*nodes, "whole", "rest", "edge", "cut"))
    ws.drop("light", "leaves", "leaf")
    got = ordered(docs.alias("d").join(small(marks).alias("l"), same("d", "l")).select("d.key", "d.row", "whole", "rest", "edge", "cut"))
    part = (F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("bin") < F.col("edge")) | ((F.col("bin") == F.col("edge")) & (F.col("hash") <= F.coalesce("cut", F.lit(-(2**63)).cast("long")))))
    got = got.withColumn("times", F.col("whole") + part.cast("int")).where("times > 0")
    return got.select("row.*", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"))
