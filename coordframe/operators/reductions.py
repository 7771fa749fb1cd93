"""Reductions, scans, sorts and search."""

from __future__ import annotations

import builtins
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import types as T
from ..functions.registry import any_nan, divide_float, nan
from ..relation import VALUE, Relation, aggregate, session
from ..tensor import Tensor, normalize_axes, promote
from .elementwise import _operator, astype, elementwise
from .shaping import expand_dims, linear, reshape

#: Vectors up to this length are searched in as one sorted array on each executor.
MAX_SEARCHED = 1 << 20


def _keep(out: Tensor, axes, keepdims: bool) -> Tensor:
    return expand_dims(out, tuple(sorted(axes))) if keepdims and axes else out


def reduce(op, x, /, *, axis=None, dtype=None, keepdims=False, init=None) -> Tensor:
    """Folds any binary operator along axes; ``init`` enters once for each result cell."""
    x, op = promote(x), _operator(op)
    axes = normalize_axes(axis, x.ndim)
    out = x.dtype if dtype is None else T.as_dtype(dtype)
    if dtype is None and op.name not in ("add", "multiply", "choose", "first_arg", "overwrite"):
        out = op.dtype(x.dtype, x.dtype)
    rel = aggregate(op, x.rel, [x.axes[a] for a in axes], init, out)
    shape = [n for k, n in enumerate(x.shape) if k not in axes]
    return _keep(Tensor(rel, shape), axes, keepdims)


def _wide(x: Tensor, dtype) -> np.dtype:
    """NumPy's type of sums and products: small integers widen."""
    return np.sum(np.zeros(1, x.dtype)).dtype if dtype is None else T.as_dtype(dtype)


def sum(x, /, *, axis=None, dtype=None, keepdims=False) -> Tensor:
    x = promote(x)
    kind = _wide(x, dtype)
    return reduce("add", x if x.dtype != T.bool_ else astype(x, kind), axis=axis, dtype=kind, keepdims=keepdims)


def prod(x, /, *, axis=None, dtype=None, keepdims=False) -> Tensor:
    x = promote(x)
    kind = _wide(x, dtype)
    return reduce("multiply", x if x.dtype != T.bool_ else astype(x, kind), axis=axis, dtype=kind, keepdims=keepdims, init=1)


def min(x, /, *, axis=None, keepdims=False, init=None) -> Tensor:
    """The smallest cell; NaN if there is one."""
    return reduce("minimum", x, axis=axis, keepdims=keepdims, init=init)


def max(x, /, *, axis=None, keepdims=False, init=None) -> Tensor:
    """The largest cell; NaN if there is one."""
    return reduce("maximum", x, axis=axis, keepdims=keepdims, init=init)


def any(x, /, *, axis=None, keepdims=False, init=None) -> Tensor:
    return reduce("logical_or", elementwise("truth", promote(x)), axis=axis, keepdims=keepdims, init=init)


def all(x, /, *, axis=None, keepdims=False, init=None) -> Tensor:
    return reduce("logical_and", elementwise("truth", promote(x)), axis=axis, keepdims=keepdims, init=init)


def _float(x: Tensor) -> Tensor:
    return x if x.dtype.kind in "fc" else astype(x, T.float64)


def mean(x, /, *, axis=None, keepdims=False) -> Tensor:
    """The sum by the dense number of cells."""
    x = _float(promote(x))
    n = math.prod(x.shape[a] for a in normalize_axes(axis, x.ndim))
    return astype(elementwise("divide", sum(x, axis=axis, keepdims=keepdims), float(n)), x.dtype)


def var(x, /, *, axis=None, correction=0.0, keepdims=False) -> Tensor:
    """The variance with ``correction`` taken off the number of cells.

    Stored cells are folded into their number, mean and squared deviations; those that hold the fill are a second
    set with no deviations, and the two are merged.  Nothing is densified.
    """
    x = _float(promote(x))
    axes = normalize_axes(axis, x.ndim)
    n = math.prod(x.shape[a] for a in axes)
    kept = [f for k, f in enumerate(x.axes) if k not in axes]
    out = x.dtype if x.dtype.kind == "f" else T.float64
    parts = ("re", "im") if T.is_complex(x.dtype) else (None,)
    fills = (x.fill_value.real, x.fill_value.imag) if T.is_complex(x.dtype) else (x.fill_value,)
    column = [(F.col(VALUE)[p] if p else F.col(VALUE)).cast("double") for p in parts]
    stats = [c for k, v in enumerate(column) for c in (F.avg(v).alias(f"__m{k}"), F.var_pop(v).alias(f"__s{k}"))]
    df = x.df.groupBy(*kept).agg(F.count("*").cast("double").alias("__k"), *stats)
    k, total = F.col("__k"), F.lit(0.0)
    for j, fill in enumerate(fills):
        apart = F.col(f"__m{j}") - float(fill)
        both = apart * apart * k * (n - k) / float(builtins.max(n, 1)) if np.isfinite(fill) else F.lit(float("nan"))
        total = total + F.col(f"__s{j}") * k + F.when(k < n, both).otherwise(0.0)
    with np.errstate(all="ignore"):
        whole = (np.float64(0.0 if np.isfinite(fills).all() else np.nan) / np.float64(n - correction)).astype(out)[()]
    value = divide_float(total, F.lit(float(n - correction)))
    value = value if kept else F.when(k > 0, value).otherwise(float(whole))
    made = df.select(*kept, value.cast(T.storage(out)).alias(VALUE))
    shape = [m for a, m in enumerate(x.shape) if a not in axes]
    rel = Relation(made, tuple(kept), {f: x.rel.dims[f] for f in kept}, whole, out).normal()
    return _keep(Tensor(rel, shape), axes, keepdims)


def std(x, /, *, axis=None, correction=0.0, keepdims=False) -> Tensor:
    return elementwise("sqrt", var(x, axis=axis, correction=correction, keepdims=keepdims))


def count_nonzero(x, /, *, axis=None, keepdims=False) -> Tensor:
    return sum(elementwise("truth", promote(x)), axis=axis, dtype=T.int64, keepdims=keepdims)


def count_nonfill(x, /, *, axis=None, keepdims=False) -> Tensor:
    """How many cells differ from the fill; NaN equals NaN."""
    x = promote(x)
    return sum(elementwise("not_same", x, Tensor(Relation(x.df.limit(0), x.axes, x.rel.dims, x.fill_value, x.dtype))), axis=axis, dtype=T.int64, keepdims=keepdims)


def _arg(x, axis, keepdims: bool, largest: bool) -> Tensor:
    x = promote(x)
    shape, axes = x.shape, None
    if axis is None:
        axes = tuple(range(x.ndim))
        x = reshape(x, (-1,))
        axis = 0
    axis = normalize_axes(axis, x.ndim)[0]
    f, n = x.axes[axis], x.shape[axis]
    if not n:
        raise ValueError("no cells to choose from")
    kept = [g for g in x.axes if g != f]
    v = F.col(VALUE).cast("int") if x.dtype == T.bool_ else F.col(VALUE)
    isnan = any_nan(F.col(VALUE)) if T.is_float(x.dtype) else F.lit(False)
    found = F.max(F.struct(isnan.alias("nan"), v.alias("x"), (-F.col(f)).alias("at"))) if largest else F.min(F.struct((~isnan).alias("nan"), v.alias("x"), F.col(f).alias("at")))
    fill = x.fill_value
    # the lowest coordinate without a row holds the fill, which takes part: 0, or the one behind a row whose neighbour is missing
    if kept:
        rank = x.df.withColumn("__r", F.row_number().over(Window.partitionBy(*kept).orderBy(f)) - 1)
        gap = F.coalesce(F.min(F.when(F.col(f) > F.col("__r"), F.col("__r"))), F.count("*")).alias("__gap")
        df = rank.groupBy(*kept).agg(found.alias("b"), gap)
    else:
        rows = x.df.select(f)
        behind = rows.select((F.col(f) + 1).alias(f)).unionByName(session().range(1).select(F.col("id").alias(f)))
        df = x.df.agg(found.alias("b")).crossJoin(behind.join(rows, f, "left_anti").agg(F.min(f).alias("__gap")))
    lit = F.lit(int(fill)) if x.dtype == T.bool_ else T.literal(fill, x.dtype)
    fill_nan = bool(T.is_float(x.dtype) and np.isnan(fill))
    at = F.when(F.lit(largest), -F.col("b.at")).otherwise(F.col("b.at"))
    if fill_nan:
        wins = (F.col("b.nan") != F.lit(largest)) | (F.col("__gap") < at)
    else:
        has_nan = F.col("b.nan") if largest else ~F.col("b.nan")
        beyond = lit > F.col("b.x") if largest else lit < F.col("b.x")
        wins = ~has_nan & (beyond | ((lit == F.col("b.x")) & (F.col("__gap") < at)))
    out = F.when((F.col("__gap") < n) & wins, F.col("__gap")).otherwise(at)
    if not kept:
        out = F.coalesce(out, F.lit(0))
    rel = Relation(df.select(*kept, out.cast("bigint").alias(VALUE)), tuple(kept), {g: x.rel.dims[g] for g in kept}, np.int64(0), T.int64).normal()
    result = Tensor(rel)
    if axes is not None:
        return reshape(result, (1,) * len(shape)) if keepdims else result
    return _keep(result, (axis,), keepdims)


def argmin(x, /, *, axis=None, keepdims=False) -> Tensor:
    """The first index of the smallest cell; of a NaN if there is one."""
    return _arg(x, axis, keepdims, False)


def argmax(x, /, *, axis=None, keepdims=False) -> Tensor:
    """The first index of the largest cell; of a NaN if there is one."""
    return _arg(x, axis, keepdims, True)


def _by(x, key, axis, keepdims: bool, pick) -> Tensor:
    from .shaping import squeeze, take_along_axis

    x, key = promote(x), promote(key)
    if x.shape != key.shape:
        raise ValueError(f"shapes {x.shape} and {key.shape} differ")
    if axis is None:
        shape, x, key, axis = x.shape, reshape(x, (-1,)), reshape(key, (-1,)), 0
        found = take_along_axis(x, pick(key, axis=0, keepdims=True), axis=0)
        return reshape(found, (1,) * len(shape)) if keepdims else squeeze(found, 0)
    axis = normalize_axes(axis, x.ndim)[0]
    found = take_along_axis(x, pick(key, axis=axis, keepdims=True), axis=axis)
    return found if keepdims else squeeze(found, axis)


def min_by(x, key, /, *, axis=None, keepdims=False) -> Tensor:
    """The cell of x where the key is smallest; the first of ties."""
    return _by(x, key, axis, keepdims, argmin)


def max_by(x, key, /, *, axis=None, keepdims=False) -> Tensor:
    """The cell of x where the key is largest; the first of ties."""
    return _by(x, key, axis, keepdims, argmax)


def _fibres(x: Tensor, axis: int, constant_ok: bool) -> Relation:
    """All cells of the fibres along an axis: of every fibre, or of stored ones if the others stay constant."""
    return x.rel.dense([x.axes[axis]]) if constant_ok else x.rel.dense()


def _axis1(x: Tensor, axis) -> int:
    if axis is None:
        if x.ndim != 1:
            raise ValueError("an axis is needed for more than one axis")
        return 0
    return normalize_axes(axis, x.ndim)[0]


#: Vectors are scanned in blocks of as many coordinates, and sorted in as many ranges of values, so that no task has all their cells.
SCAN_BLOCK, SORT_RANGES = 1 << 16, 64

_RUNNING = {"add": F.sum, "minimum": F.min, "maximum": F.max, "logical_and": F.bool_and, "logical_or": F.bool_or}


def cumulative(op, x, /, *, axis=None, dtype=None, include_initial=False) -> Tensor:
    """The inclusive scan of an associative operator along an axis."""
    x, op = promote(x), _operator(op)
    axis = _axis1(x, axis)
    if x.dtype == T.bool_ and op.name in ("add", "multiply"):
        raise TypeError("scans of booleans need a dtype")
    kind = x.dtype if dtype is None else T.as_dtype(dtype)
    f = x.axes[axis]
    kept = [g for g in x.axes if g != f]
    still = op.idempotent or (op.identity is not None and T.same(x.fill_value, op.identity)) or (op.name == "multiply" and x.fill_value == 0)
    rel = _fibres(x, axis, bool(still) and x.dtype == kind)
    v = T.cast(F.col(VALUE), x.dtype, kind)
    fill = np.asarray(x.fill_value).astype(kind)[()]
    total = _total(op, v, kind)
    if total is not None:
        df = rel.df
        if kept:
            col = total(Window.partitionBy(*kept).orderBy(f).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        else:
            block = F.shiftright(f, int(math.log2(SCAN_BLOCK))).alias("__b")
            blocks = df.groupBy(block).agg(total(None).alias("__t"))
            before = _total(op, F.col("__t"), T.float64 if T.is_float(kind) else kind)(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block
            blocks = blocks.select("__b", before.alias("__before"))
            df = df.withColumn("__b", block).join(blocks, "__b")
            inside = total(Window.partitionBy("__b").orderBy(f).rowsBetween(Window.unboundedPreceding, Window.currentRow))
            wide = T.float64 if T.is_float(kind) else kind if kind == T.bool_ else T.int64
            both = op.build([F.col("__before").cast(T.storage(wide)), inside.cast(T.storage(wide))], [wide, wide], wide)
            col = F.when(F.col("__before").isNull(), inside).otherwise(both)
        col = T.wrap(col, kind) if T.is_integer(kind) else col.cast(T.storage(kind))
        df = df.select(*x.axes, col.alias(VALUE))
    else:
        df = _scan(op, rel, kept, f, kind)
    out = Tensor(Relation(df, x.axes, x.rel.dims, fill if still else np.zeros((), kind)[()], kind).normal())
    if not include_initial:
        return out
    from .creation import full
    from .shaping import concat

    start = full([1 if k == axis else n for k, n in enumerate(x.shape)], op.identity, dtype=kind)
    return concat([start, out], axis=axis)


def _total(op, v, kind: np.dtype):
    """The fold of a column as a function of the window it runs over (None: a group); None if Spark has no aggregate for it."""

    def over(col, window):
        return col if window is None else col.over(window)

    if op.name == "multiply" and T.is_float(kind):
        return lambda w: over(F.product(v.cast("double")), w)
    if op.name not in _RUNNING:
        return None
    fold = _RUNNING[op.name]
    if T.is_float(kind) and op.name in ("minimum", "maximum"):
        return lambda w: F.when(over(F.bool_or(F.isnan(v)), w), nan()).otherwise(over(fold(v.cast("double")), w))
    return lambda w: over(fold(v.cast("double") if T.is_float(kind) else v), w)


def _scan(op, rel: Relation, kept: list[str], f: str, kind: np.dtype):
    keys = kept or ["__all"]
    df = rel.df if kept else rel.df.withColumn("__all", F.lit(0).cast("bigint"))
    fields = rel.fields

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(f)
        out, total = [], None
        for value in pdf[VALUE].to_numpy().astype(kind):
            total = value if total is None else np.asarray(op.value(total, value)).astype(kind)[()]
            out.append(total)
        return pd.DataFrame({**{g: pdf[g].to_numpy() for g in fields}, VALUE: out})

    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"{g} bigint" for g in fields) + f", {VALUE} {T.storage(kind)}")


def cumulative_sum(x, /, *, axis=None, dtype=None, include_initial=False) -> Tensor:
    x = promote(x)
    return cumulative("add", x, axis=axis, dtype=_wide(x, dtype), include_initial=include_initial)


def cumulative_prod(x, /, *, axis=None, dtype=None, include_initial=False) -> Tensor:
    x = promote(x)
    return cumulative("multiply", x, axis=axis, dtype=_wide(x, dtype), include_initial=include_initial)


def _ranges(df: DataFrame, value) -> DataFrame:
    """``df`` with ``__p``: which of SORT_RANGES ranges a value lies in, by quantiles of the values; NaN and null come last.

    Equal values lie in one range, and ranges follow the order of values.
    """
    known = F.when(~F.isnan(value), value) if dict(df.select(value.alias("x")).dtypes)["x"] in ("double", "float") else value
    cuts = df.agg(F.percentile_approx(known, [k / SORT_RANGES for k in range(1, SORT_RANGES)], 2000).alias("__cuts"))
    at = F.size(F.filter("__cuts", lambda c: c < known))
    return df.crossJoin(F.broadcast(cuts)).withColumn("__p", F.when(known.isNull(), SORT_RANGES + 1).otherwise(at)).drop("__cuts")


def _ranked(x: Tensor, axis: int, descending: bool, constant_ok: bool):
    f = x.axes[axis]
    kept = [g for g in x.axes if g != f]
    rel = _fibres(x, axis, constant_ok)
    v = F.col(VALUE)
    order = []
    if T.is_float(x.dtype):
        order.append(F.isnan(v))
        v = F.when(v == 0, F.lit(0.0)).otherwise(v)
    order += [v.desc() if descending else v.asc(), F.col(f).asc()]
    if kept:
        return rel.df.withColumn("__r", (F.row_number().over(Window.partitionBy(*kept).orderBy(*order)) - 1).cast("bigint")), f
    df = _ranges(rel.df, v.cast("int") if x.dtype == T.bool_ else v)
    turned = F.when(F.col("__p") > SORT_RANGES, F.col("__p")).otherwise(-F.col("__p") if descending else F.col("__p"))
    df = df.withColumn("__p", turned)
    sizes = df.groupBy("__p").agg(F.count("*").alias("__k"))
    before = sizes.select("__p", (F.sum("__k").over(Window.orderBy("__p")) - F.col("__k")).alias("__before"))  # a row for each range
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return df.withColumn("__r", rank).join(F.broadcast(before), "__p").withColumn("__r", (F.col("__r") + F.col("__before")).cast("bigint")), f


def sort(x, /, *, axis=-1, descending=False, stable=True) -> Tensor:
    """Cells in order along an axis, NaN last."""
    x = promote(x)
    axis = normalize_axes(axis, x.ndim)[0]
    df, f = _ranked(x, axis, descending, True)
    df = df.select(*[F.col("__r").alias(f) if g == f else F.col(g) for g in x.axes], VALUE)
    return Tensor(Relation(df, x.axes, x.rel.dims, x.fill_value, x.dtype).normal())


def argsort(x, /, *, axis=-1, descending=False, stable=True) -> Tensor:
    """The stable permutation that sorts along an axis."""
    x = promote(x)
    axis = normalize_axes(axis, x.ndim)[0]
    df, f = _ranked(x, axis, descending, False)
    df = df.select(*[F.col("__r").alias(f) if g == f else F.col(g) for g in x.axes], F.col(f).alias(VALUE))
    return Tensor(Relation(df, x.axes, x.rel.dims, np.int64(0), T.int64).normal())


def searchsorted(x1, x2, /, *, side="left", sorter=None) -> Tensor:
    """Where the cells of x2 would be put into the sorted vector x1.

    A vector of up to MAX_SEARCHED cells goes to each executor as one array; a longer one is merged
    with the cells in ranges of values by running counts.  Both compare in the common type of the two.
    """
    if side not in ("left", "right"):
        raise ValueError("side is left or right")
    x1, x2 = promote(x1), promote(x2)
    if sorter is not None:
        from .shaping import take

        x1 = take(x1, sorter, axis=0)
    n = x1.shape[0]
    kind = np.result_type(x1.dtype, x2.dtype)
    if n <= MAX_SEARCHED:
        host = x1.to_numpy()

        @F.pandas_udf("bigint")
        def find(v):
            import pandas as pd

            return pd.Series(np.searchsorted(host.astype(kind), v.to_numpy().astype(kind), side=side).astype("int64"))

        fill = np.int64(np.searchsorted(host, x2.fill_value, side=side))
        return Tensor(Relation(x2.df.select(*x2.axes, find(F.col(VALUE)).alias(VALUE)), x2.axes, x2.rel.dims, fill, T.int64).normal())
    first = 0 if side == "left" else 1
    edges = x1.rel.dense().df.select(F.col(VALUE).cast(T.storage(kind)).alias("x"), F.lit(1 - first).alias("tag"), F.lit(None).cast("bigint").alias("at"))
    cells = x2.rel.dense().df.select(F.col(VALUE).cast(T.storage(kind)).alias("x"), F.lit(first).alias("tag"), linear(x2).alias("at"))
    merged = _ranges(edges.unionByName(cells), F.col("x"))
    part = merged.groupBy("__p").agg(F.count_if(F.col("at").isNull()).alias("k"))
    before = part.withColumn("before", F.sum("k").over(Window.orderBy("__p")) - F.col("k")).select("__p", "before")
    run = F.count_if(F.col("at").isNull()).over(Window.partitionBy("__p").orderBy("x", "tag").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = merged.withColumn("run", run).where("at is not null").join(F.broadcast(before), "__p")  # a row for each range
    flat = found.select(F.col("at").alias("i0"), (F.col("run") + F.col("before")).cast("bigint").alias(VALUE))
    return reshape(Tensor(Relation(flat, ("i0",), {"i0": x2.size}, np.int64(0), T.int64).normal()), x2.shape)
