"""Products of two factors whose join would write far more rows than either holds.

``tiled`` serves dense results: blocks of rows of both factors meet in one task, which multiplies them and writes each
cell of the result once.  ``packed`` serves sparse ones: the cells of a common index travel as two lists, neighbouring
indices together, and meet only where they are summed at once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .. import types as T
from ..functions.registry import OPS
from ..relation import VALUE, Relation, aggregate

#: Joins below this many cells stay joins, and so do those that grow less than GROWS times.
LEAST, GROWS = 1 << 22, 2
#: Estimates follow the bytes of compressed files; tables have some six times as many rows.
COMPRESSED = 6
#: A block holds at most so many rows, and about so many stored cells; a list at most LIST cells.
ROWS, CELLS, LIST = 1024, 1 << 20, 1 << 16
#: The result is dense if that many products are expected for each of its cells.
DENSE = 8


def multiplied(a: Relation, b: Relation, gone: Sequence[str], sizes: tuple[float, float], dims: Mapping[str, int]) -> Relation | None:
    """The sum over ``gone`` of ``a * b``, or None where a plain join does."""
    shared = [f for f in a.fields if f in b.fields]
    kept, m, n = [f for f in shared if f not in gone], [f for f in a.fields if f not in shared], [f for f in b.fields if f not in shared]
    if not m or not n or set(gone) - set(shared) or not gone or any(r.dtype != T.int64 for r in (a, b)) or max(a.size, b.size) >= 1 << 62:
        return None
    full = [float(r.size) if r.size <= 16 * s else min(r.size, COMPRESSED * s) for r, s in zip((a, b), sizes, strict=True)]
    joined = full[0] * full[1] / math.prod(dims[f] for f in shared)
    if joined < LEAST or joined < GROWS * sum(full):
        return None
    if joined >= DENSE * math.prod(dims[f] for f in (*kept, *m, *n)):
        return tiled(a, b, kept, list(gone), m, n, full, dims)
    return packed(a, b, shared, m, n, kept)


def _linear(fields: Sequence[str], dims: Mapping[str, int]):
    """One number for several coordinates, in row-major order."""
    out = F.lit(0).cast("bigint")
    for f in fields:
        out = out * F.lit(dims[f]).cast("bigint") + F.col(f)
    return out


def _apart(number: np.ndarray, fields: Sequence[str], dims: Mapping[str, int]) -> dict[str, np.ndarray]:
    out = {}
    for f in reversed(fields):
        number, out[f] = np.divmod(number, dims[f])
    return out


def _product(x: np.ndarray, y: np.ndarray, ansi: bool) -> np.ndarray:
    """x @ y in int64; beyond its range it wraps, or raises as Spark does in ANSI mode."""
    top = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(y.astype(float)).max(initial=0)) * x.shape[1]
    if ansi and top >= 2.0**62:
        exact = x.astype(object) @ y.astype(object)
        if max(exact.max(), -exact.min() - 1) >= 1 << 63:
            raise OverflowError("a sum of products is no int64; with spark.sql.ansi.enabled=false it wraps")
        return exact.astype(np.int64)
    return x @ y


def tiled(a: Relation, b: Relation, kept: list[str], gone: list[str], m: list[str], n: list[str], sizes: Sequence[float], dims: Mapping[str, int]) -> Relation:
    """Each tile of ROWS x ROWS cells is one group of one task; a block is sent to each tile of its row or column of tiles."""
    rows = [math.prod(dims[f] for f in side) for side in (m, n)]
    outer = math.prod(dims[f] for f in kept)
    width = [int(max(1, min(ROWS, r, CELLS // max(1, s / (outer * r))))) for r, s in zip(rows, sizes, strict=True)]
    count = [-(-r // w) for r, w in zip(rows, width, strict=True)]
    ansi = a.df.sparkSession.conf.get("spark.sql.ansi.enabled") == "true"
    out_fields = (*kept, *m, *n)

    def side(r: Relation, own: list[str], k: int):
        at = F.col("__at")
        df = r.df.select(*kept, _linear(own, dims).alias("__at"), _linear(gone, dims).alias("__k"), F.col(VALUE).alias("__v"))
        df = df.groupBy(*kept, "__at").agg(F.collect_list(F.struct("__k", "__v")).alias("__cells"))  # one row's cells, at most as many as the summed axes have
        df = df.withColumn(f"__b{k}", F.floor(at / F.lit(width[k])).cast("bigint"))
        return df.withColumn(f"__b{1 - k}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count[1 - k] - 1).cast("bigint")))).select(*kept, "__b0", "__b1", "__at", "__cells")

    def dense(table: pa.Table, ks: np.ndarray, w: int, first: int) -> np.ndarray:
        at, k, v = table
        out = np.zeros((w, len(ks)), np.int64)
        place = np.searchsorted(ks, k)
        out[at - first, place] = v
        return out

    def cells(table: pa.Table):
        lists = table.column("__cells").combine_chunks()
        flat = lists.flatten()
        times = np.diff(lists.offsets.to_numpy())
        return np.repeat(table.column("__at").to_numpy(), times), flat.field("__k").to_numpy(), flat.field("__v").to_numpy()

    def multiply(key, left: pa.Table, right: pa.Table) -> pa.Table:
        *fixed, bm, bn = (x.as_py() for x in key)
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        x, y = cells(left), cells(right)
        ks = np.intersect1d(x[1], y[1])
        first = bm * width[0], bn * width[1]
        total = np.zeros(tuple(width), np.int64)
        x, y = ([c[np.isin(side[1], ks)] for c in side] for side in (x, y))
        step = max(1, (1 << 22) // max(width)) if not ansi else max(1, len(ks))
        for start in range(0, len(ks), step):  # some summed indices at a time, so that no block is large when dense
            some = ks[start : start + step]
            p, q = ([c[(side[1] >= some[0]) & (side[1] <= some[-1])] for c in side] for side in (x, y))
            total += _product(dense(p, some, width[0], first[0]), dense(q, some, width[1], first[1]).T, ansi)
        i, j = np.nonzero(total)
        found = {**{f: np.full(len(i), v) for f, v in zip(kept, fixed, strict=True)}, **_apart(i + first[0], m, dims), **_apart(j + first[1], n, dims)}
        return pa.table([pa.array(found[f], pa.int64()) for f in out_fields] + [pa.array(total[i, j])], schema=schema)

    schema = pa.schema([(f, pa.int64()) for f in (*out_fields, VALUE)])
    by = [*kept, "__b0", "__b1"]
    made = side(a, m, 0).groupBy(*by).cogroup(side(b, n, 1).groupBy(*by)).applyInArrow(multiply, ", ".join(f"`{f}` bigint" for f in (*out_fields, VALUE)))
    return Relation(made, out_fields, {f: dims[f] for f in out_fields}, np.int64(0), T.int64)


def packed(a: Relation, b: Relation, shared: list[str], m: list[str], n: list[str], kept: list[str]) -> Relation:
    """Two lists for each common index are dealt in ranges of it; pairs are made and summed within a task before they travel."""
    dims = {**a.dims, **b.dims}

    def lists(r: Relation, own: list[str], name: str):
        block = F.floor(F.col(own[-1]) / F.lit(LIST)).cast("bigint")
        df = r.df.withColumn(f"__{name}b", block).groupBy(*shared, *own[:-1], f"__{name}b")
        return df.agg(F.collect_list(F.struct(own[-1], F.col(VALUE).alias(f"__{name}v"))).alias(f"__{name}"))

    pairs = lists(a, m, "x").join(lists(b, n, "y"), shared).repartitionByRange(*shared, "__xb", "__yb")
    pairs = pairs.select("*", F.explode("__x").alias("__p")).select("*", F.explode("__y").alias("__q"))
    value = OPS["multiply"].build([F.col("__p.__xv"), F.col("__q.__yv")], [T.int64, T.int64], T.int64)
    ends = {m[-1]: F.col(f"__p.{m[-1]}"), n[-1]: F.col(f"__q.{n[-1]}")}
    fields = (*shared, *m, *n)
    df = pairs.select(*[ends.get(f, F.col(f)).alias(f) for f in fields], value.alias(VALUE))
    made = Relation(df, fields, {f: dims[f] for f in fields}, np.int64(0), T.int64)
    return aggregate(OPS["add"], made, [f for f in shared if f not in kept])
