"""Sources: constant, range, identity and grid tensors, and implicit patterns."""

from __future__ import annotations

import builtins
import math

import numpy as np
from pyspark.sql import functions as F

from .. import types as T
from ..relation import VALUE, Relation, session
from ..tensor import Tensor, axis_names, dims_of, promote


def _empty_rel(shape, fill, dtype) -> Relation:
    cols = [F.lit(0).cast("bigint").alias(f) for f in axis_names(len(shape))]
    df = session().range(0).select(*cols, T.literal(fill, dtype).alias(VALUE))
    return Relation(df, axis_names(len(shape)), dims_of(shape), np.asarray(fill).astype(dtype)[()], dtype)


def full(shape, fill_value, *, dtype=None, device=None) -> Tensor:
    """A constant tensor: no rows, only a fill."""
    shape = (shape,) if np.isscalar(shape) else tuple(int(n) for n in shape)
    if isinstance(fill_value, Tensor):
        fill_value = fill_value.item()
    dtype = np.asarray(fill_value).dtype if dtype is None else T.as_dtype(dtype)
    return Tensor(_empty_rel(shape, fill_value, dtype))


def full_like(x, /, fill_value, *, dtype=None, device=None) -> Tensor:
    x = promote(x)
    return full(x.shape, fill_value, dtype=x.dtype if dtype is None else dtype)


def zeros(shape, *, dtype=None, device=None) -> Tensor:
    return full(shape, 0, dtype=T.float64 if dtype is None else dtype)


def ones(shape, *, dtype=None, device=None) -> Tensor:
    return full(shape, 1, dtype=T.float64 if dtype is None else dtype)


def empty(shape, *, dtype=None, device=None) -> Tensor:
    return zeros(shape, dtype=dtype)


def zeros_like(x, /, *, dtype=None, device=None) -> Tensor:
    return full_like(x, 0, dtype=dtype)


def ones_like(x, /, *, dtype=None, device=None) -> Tensor:
    return full_like(x, 1, dtype=dtype)


def empty_like(x, /, *, dtype=None, device=None) -> Tensor:
    return zeros_like(x, dtype=dtype)


def _counted(n: int, value, dtype) -> Tensor:
    """A vector whose cell at i is a column expression of i."""
    i = F.col("id")
    df = session().range(n).select(i.alias("i0"), value(i).cast(T.storage(dtype)).alias(VALUE))
    return Tensor(Relation(df, ("i0",), {"i0": n}, np.zeros((), dtype)[()], dtype).normal())


def arange(start, /, stop=None, step=1, *, dtype=None, device=None) -> Tensor:
    """start, start + step, .. below stop."""
    if stop is None:
        start, stop = 0, start
    kind = np.arange(start, start, step).dtype if dtype is None else T.as_dtype(dtype)
    n = max(0, math.ceil((stop - start) / step))
    return _counted(n, lambda i: F.lit(start) + i * F.lit(step), kind)


def linspace(start, stop, /, num, *, dtype=None, endpoint=True, device=None) -> Tensor:
    """``num`` evenly spaced numbers; the last one is ``stop`` exactly if ``endpoint``."""
    kind = T.float64 if dtype is None else T.as_dtype(dtype)
    parts = num - 1 if endpoint else num
    step = (stop - start) / parts if parts > 0 else 0.0
    return _counted(num, lambda i: F.when((i == num - 1) & F.lit(endpoint and num > 1), F.lit(float(stop))).otherwise(F.lit(float(start)) + i * F.lit(float(step))), kind)


def eye(n_rows, n_cols=None, *, k=0, dtype=None, device=None) -> Tensor:
    """Ones on the k-th diagonal."""
    n_cols = n_rows if n_cols is None else n_cols
    kind = T.float64 if dtype is None else T.as_dtype(dtype)
    i = F.col("id")
    df = session().range(n_rows).where((i + k >= 0) & (i + k < n_cols)).select(i.alias("i0"), (i + k).alias("i1"), T.literal(1, kind).alias(VALUE))
    return Tensor(Relation(df, ("i0", "i1"), {"i0": n_rows, "i1": n_cols}, np.zeros((), kind)[()], kind))


def _unravelled(number, shape) -> list:
    """The coordinates of a row-major number."""
    return [F.call_function("div", number, F.lit(math.prod(shape[k + 1 :])).cast("bigint")) % size for k, size in enumerate(shape)]


def index_tensor(shape) -> Tensor:
    """Each cell holds its row-major number."""
    df = session().range(math.prod(shape))
    df = df.select(*[c.alias(f"i{k}") for k, c in enumerate(_unravelled(F.col("id"), shape))], F.col("id").alias(VALUE))
    return Tensor(Relation(df, axis_names(len(shape)), dims_of(shape), np.int64(0), T.int64).normal())


def pattern(shape, test, dtype=bool) -> Tensor:
    """Ones where ``test(i0, i1, ..)`` of the coordinates holds, for any test: every coordinate is looked at once, by arithmetic."""
    kind, names = T.as_dtype(dtype), axis_names(len(shape))
    df = session().range(math.prod(shape)).select(*[c.alias(f) for f, c in zip(names, _unravelled(F.col("id"), shape), strict=True)])
    df = df.where(test(*[F.col(f) for f in names])).select(*names, T.literal(1, kind).alias(VALUE))
    return Tensor(Relation(df, names, dims_of(shape), np.zeros((), kind)[()], kind))


def _band(n: int, m: int, first, last, dtype) -> Tensor:
    """Ones from column ``first(i)`` to ``last(i)`` of each row: only the cells that are there are made."""
    kind, i = T.as_dtype(dtype), F.col("id")
    low, high = F.greatest(first(i), F.lit(0)).cast("bigint"), F.least(last(i), F.lit(m - 1)).cast("bigint")
    df = session().range(n).select(i.alias("i0"), low.alias("a"), high.alias("b")).where("a <= b")
    df = df.select("i0", F.explode(F.sequence("a", "b")).alias("i1"), T.literal(1, kind).alias(VALUE))
    return Tensor(Relation(df, ("i0", "i1"), {"i0": n, "i1": m}, np.zeros((), kind)[()], kind))


def upper_triangle(n, m=None, k=0, dtype=bool) -> Tensor:
    m = n if m is None else m
    return _band(n, m, lambda i: i + k, lambda i: F.lit(m - 1), dtype)


def lower_triangle(n, m=None, k=0, dtype=bool) -> Tensor:
    return _band(n, n if m is None else m, lambda i: F.lit(0), lambda i: i + k, dtype)


def reverse_tensor(n, dtype=bool) -> Tensor:
    return _band(n, n, lambda i: n - 1 - i, lambda i: n - 1 - i, dtype)


def roll_tensor(n, k, dtype=bool) -> Tensor:
    return _band(n, n, lambda i: F.pmod(i - k, F.lit(n)), lambda i: F.pmod(i - k, F.lit(n)), dtype)


def repeat_tensor(n, k, dtype=bool) -> Tensor:
    return _band(n * k, n, lambda i: F.floor(i / k), lambda i: F.floor(i / k), dtype)


def one_hot(n, at, dtype=bool) -> Tensor:
    return pattern((n,), lambda i: i == at, dtype)


def parity_mask(n, odd=False, dtype=bool) -> Tensor:
    return pattern((n,), lambda i: i % 2 == int(odd), dtype)


def reshape_mask(shape, target, dtype=bool) -> Tensor:
    """Ones where the row-major numbers in two shapes agree: one cell for each number that both have."""
    kind, names = T.as_dtype(dtype), axis_names(len(shape) + len(target))
    df = session().range(builtins.min(math.prod(shape), math.prod(target)))
    at = [*_unravelled(F.col("id"), shape), *_unravelled(F.col("id"), target)]
    df = df.select(*[c.alias(f) for f, c in zip(names, at, strict=True)], T.literal(1, kind).alias(VALUE))
    return Tensor(Relation(df, names, dims_of((*shape, *target)), np.zeros((), kind)[()], kind))


def meshgrid(*arrays, indexing="xy") -> tuple[Tensor, ...]:
    """Coordinate grids of vectors."""
    from .shaping import broadcast_to, reshape

    arrays = [promote(a) for a in arrays]
    n = len(arrays)
    place = list(range(n))
    if indexing == "xy" and n > 1:
        place[0], place[1] = 1, 0
    elif indexing not in ("xy", "ij"):
        raise ValueError("indexing is xy or ij")
    shape = [0] * n
    for a, p in zip(arrays, place, strict=True):
        shape[p] = a.size
    out = []
    for a, p in zip(arrays, place, strict=True):
        spread = [1] * n
        spread[p] = a.size
        out.append(broadcast_to(reshape(a, tuple(spread)), tuple(shape)))
    return tuple(out)


__all__ = [k for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")]
