"""Pointwise functions: one operator object each, applied with NumPy's broadcasting."""

from __future__ import annotations

import numpy as np

from .. import types as T
from ..functions.registry import OPS, Op, custom
from ..relation import map_join
from ..tensor import Tensor, asarray, axis_names, promote, shape_of


def _operator(op) -> Op:
    if isinstance(op, Op):
        return op
    if isinstance(op, str):
        return OPS[op]
    name = getattr(op, "__name__", "custom")
    return OPS[name] if isinstance(op, np.ufunc) and name in OPS else custom(name, op)


def broadcast_relations(args, shape):
    """The arguments as relations over the result's axes; axes of size one that are stretched are dropped."""
    n = len(shape)
    names = axis_names(n)
    out = []
    for a in args:
        if not isinstance(a, Tensor):
            out.append(a)
            continue
        label, drop = [], []
        for axis, size, target in zip(a.axes, a.shape, range(n - a.ndim, n), strict=True):
            label.append((axis, names[target]))
            if size == 1 and shape[target] != 1:
                drop.append(names[target])
        rel = a.rel.relabel(dict(label))
        kept = [f for f in rel.fields if f not in drop]
        out.append(rel if not drop else rel.select(kept, {}, {}))
    return out


def elementwise(op, *args) -> Tensor:
    """Any operator (object, name, NumPy ufunc or function of arrays) at each cell."""
    op = _operator(op)
    args = [a if isinstance(a, Tensor) or np.isscalar(a) else asarray(a) for a in args]
    if not any(isinstance(a, Tensor) for a in args):
        return asarray(op.value(*args))
    shape = np.broadcast_shapes(*[shape_of(a) for a in args])
    rels = broadcast_relations(args, shape)
    names = axis_names(len(shape))
    dims = dict(zip(names, shape, strict=True))
    covered = {f for r in rels if hasattr(r, "fields") for f in r.fields}
    missing = [f for f in names if f not in covered]  # axes that every tensor stretches can't be
    if missing:
        first = next(i for i, r in enumerate(rels) if hasattr(r, "fields"))
        rels[first] = rels[first].expand([f for f in names if f in rels[first].fields or f in missing], dims)
    return Tensor(map_join(op, rels, names))


def _make(name: str, arity: int):
    op = OPS[name]
    if arity == 1:

        def function(x, /):
            return elementwise(op, x)

    else:

        def function(x1, x2, /):
            return elementwise(op, x1, x2)

    function.__name__ = function.__qualname__ = name
    function.__doc__ = f"``{name}`` at each cell, with NumPy's results for NaN, infinities, signs and overflow."
    return function


UNARY = (
    "abs acos acosh asin asinh atan atanh bitwise_invert ceil conj cos cosh exp expm1 floor imag iscomplexobj isfinite isinf isnan log log10 log1p log2 "
    "logical_not negative positive real reciprocal round sign signbit sin sinh sqrt square tan tanh trunc"
).split()
BINARY = (
    "add atan2 bitwise_and bitwise_left_shift bitwise_or bitwise_right_shift bitwise_xor copysign divide equal floor_divide greater greater_equal hypot less "
    "less_equal logaddexp logical_and logical_or logical_xor maximum minimum mod multiply nextafter not_equal not_same pow power remainder same subtract truediv"
).split()
for _name in UNARY:
    globals()[_name] = _make(_name, 1)
for _name in BINARY:
    globals()[_name] = _make(_name, 2)


def where(condition, x1, x2, /) -> Tensor:
    """x1 where the condition holds, else x2."""
    return elementwise("where", condition, x1, x2)


def clip(x, /, min=None, max=None) -> Tensor:
    """Values cut to [min, max]; the dtype of x stays."""
    x = promote(x)
    kind = x.dtype
    out = x
    if min is not None:
        out = elementwise("maximum", out, min)
    if max is not None:
        out = elementwise("minimum", out, max)
    return astype(out, kind)


def astype(x, dtype, /, *, copy=True, device=None) -> Tensor:
    """NumPy's conversion of each cell; fill values convert too."""
    x, target = promote(x), T.as_dtype(dtype)
    if target == x.dtype:
        return x
    with np.errstate(all="ignore"):
        fill = np.asarray(x.fill_value).astype(target)[()]
    return Tensor(x.rel.normal(T.cast(x.rel.value, x.dtype, target), fill, target))
