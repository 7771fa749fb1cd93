"""Linear algebra: products as joins and grouped sums, factorisations as one grouped function per matrix."""

from __future__ import annotations

import builtins
from collections import namedtuple

import numpy as np
from pyspark.sql import functions as F

from .. import types as T
from ..functions.registry import OPS
from ..plans.compute import cut
from ..plans.planner import contract
from ..relation import VALUE, Relation, map_join
from ..tensor import Tensor, axis_names, dims_of, normalize_axes, promote
from . import reductions, shaping
from .elementwise import elementwise

EighResult = namedtuple("EighResult", "eigenvalues eigenvectors")
QRResult = namedtuple("QRResult", "Q R")
SlogdetResult = namedtuple("SlogdetResult", "sign logabsdet")
SVDResult = namedtuple("SVDResult", "U S Vh")
LUResult = namedtuple("LUResult", "P L U")


def _product(args: list[tuple[Tensor, list[str]]], out: list[str], dtype=None) -> Tensor:
    rels = [x.labelled(names) for x, names in args]
    dims = {f: r.dims[f] for r in rels for f in r.fields}
    got = contract(OPS["add"], OPS["multiply"], rels, tuple(out))
    return Tensor(got.select(out, {}, dims), [dims[f] for f in out])


def matmul(x1, x2, /) -> Tensor:
    """Products of vectors, matrices and stacks of matrices."""
    a, b = promote(x1), promote(x2)
    if not a.ndim or not b.ndim:
        raise ValueError("scalars have no matrix product")
    one, two = a.ndim == 1, b.ndim == 1
    a, b = shaping.expand_dims(a, 0) if one else a, shaping.expand_dims(b, 1) if two else b
    if a.shape[-1] != b.shape[-2]:
        raise ValueError(f"sizes {a.shape[-1]} and {b.shape[-2]} differ")
    batch = np.broadcast_shapes(a.shape[:-2], b.shape[:-2])
    names = [f"b{k}" for k in range(len(batch))]
    a, b = shaping.broadcast_to(a, (*batch, *a.shape[-2:])) if a.ndim > 2 else a, shaping.broadcast_to(b, (*batch, *b.shape[-2:])) if b.ndim > 2 else b
    out = _product([(a, [*names[len(names) - a.ndim + 2 :], "m", "k"]), (b, [*names[len(names) - b.ndim + 2 :], "k", "n"])], [*names, "m", "n"])
    if two:
        out = shaping.squeeze(out, -1)
    return shaping.squeeze(out, -1 if two else -2) if one else out


def tensordot(x1, x2, /, *, axes=2) -> Tensor:
    """Contracts the last axes of x1 with the first of x2, or the listed ones."""
    a, b = promote(x1), promote(x2)
    if isinstance(axes, int):
        left, right = tuple(range(a.ndim - axes, a.ndim)), tuple(range(axes))
    else:
        left, right = normalize_axes(tuple(np.atleast_1d(axes[0]).tolist()), a.ndim), normalize_axes(tuple(np.atleast_1d(axes[1]).tolist()), b.ndim)
    if len(left) != len(right) or [a.shape[k] for k in left] != [b.shape[k] for k in right]:
        raise ValueError("contracted axes differ in size")
    an, bn = [f"a{k}" for k in range(a.ndim)], [f"b{k}" for k in range(b.ndim)]
    for p, q in zip(left, right, strict=True):
        bn[q] = an[p]
    out = [n for k, n in enumerate(an) if k not in left] + [n for k, n in enumerate(bn) if k not in right]
    return _product([(a, an), (b, bn)], out)


def vecdot(x1, x2, /, *, axis=-1) -> Tensor:
    """Sums conj(x1) * x2 along an axis."""
    a, b = shaping.broadcast_arrays(x1, x2)
    return reductions.sum(elementwise("multiply", elementwise("conj", a) if T.is_complex(a.dtype) else a, b), axis=axis)


def outer(x1, x2, /) -> Tensor:
    a, b = promote(x1), promote(x2)
    if a.ndim != 1 or b.ndim != 1:
        raise ValueError("outer needs two vectors")
    return Tensor(map_join(OPS["multiply"], [a.labelled(["i0"]), b.labelled(["i1"])], ["i0", "i1"]))


def cross(x1, x2, /, *, axis=-1) -> Tensor:
    """The product of 3-vectors along an axis."""
    a, b = shaping.broadcast_arrays(x1, x2)
    axis = normalize_axes(axis, a.ndim)[0]
    if a.shape[axis] != 3:
        raise ValueError("cross needs three components")

    def part(x, k):
        return shaping.getitem(x, (*[slice(None)] * axis, k))

    def component(i, j):
        return elementwise("subtract", elementwise("multiply", part(a, i), part(b, j)), elementwise("multiply", part(a, j), part(b, i)))

    return shaping.stack([component(1, 2), component(2, 0), component(0, 1)], axis=axis)


def matrix_power(x, n, /) -> Tensor:
    """By repeated squaring; a negative power inverts first."""
    x = promote(x)
    if x.ndim < 2 or x.shape[-1] != x.shape[-2]:
        raise ValueError("powers need square matrices")
    if n < 0:
        x, n = inv(x), -n
    out = None
    while n:
        if n & 1:
            out = x if out is None else matmul(out, x)
        n >>= 1
        if n:
            x = cut(matmul(x, x))  # used twice from here on; a checkpoint keeps the plan from doubling with each squaring
    if out is None:
        from .creation import eye

        return shaping.broadcast_to(eye(x.shape[-1], dtype=x.dtype), x.shape)
    return out


def vector_norm(x, /, *, axis=None, keepdims=False, ord=2) -> Tensor:
    """A p-norm; powers are taken of numbers scaled by the largest (smallest for p < 0), so none overflows."""
    x = elementwise("abs", reductions._float(promote(x)))
    if ord == 0:
        return elementwise("add", reductions.sum(elementwise("not_equal", x, 0), axis=axis, dtype=x.dtype, keepdims=keepdims), 0.0)
    if ord == float("inf"):
        return reductions.max(x, axis=axis, keepdims=keepdims)
    if ord == float("-inf"):
        return reductions.min(x, axis=axis, keepdims=keepdims)
    if ord == 1:
        return reductions.sum(x, axis=axis, keepdims=keepdims)
    top = reductions.max(x, axis=axis, keepdims=True) if ord > 0 else reductions.min(x, axis=axis, keepdims=True)
    usable = elementwise("logical_and", elementwise("isfinite", top), elementwise("greater", top, 0))
    scale = elementwise("where", usable, top, np.ones((), x.dtype)[()].item())
    part = elementwise("divide", x, scale)
    total = reductions.sum(elementwise("square", part) if ord == 2 else elementwise("power", part, float(ord)), axis=axis, keepdims=True)
    out = elementwise("multiply", elementwise("sqrt", total) if ord == 2 else elementwise("power", total, 1.0 / ord), scale)
    out = out if out.dtype == x.dtype else elementwise_cast(out, x.dtype)
    return out if keepdims else shaping.squeeze(out, normalize_axes(axis, x.ndim)) if x.ndim else out


def elementwise_cast(x: Tensor, dtype) -> Tensor:
    from .elementwise import astype

    return astype(x, dtype)


def matrix_norm(x, /, *, keepdims=False, ord="fro") -> Tensor:
    """fro, nuc, 1, -1, 2, -2, inf or -inf of the last two axes."""
    x = promote(x)
    if ord == "fro":
        return vector_norm(x, axis=(-2, -1), keepdims=keepdims)
    if ord in (1, -1, float("inf"), float("-inf")):
        rows = abs(ord) != 1
        total = reductions.sum(elementwise("abs", reductions._float(x)), axis=-1 if rows else -2, keepdims=True)
        pick = reductions.max if ord > 0 else reductions.min
        return pick(total, axis=(-2, -1), keepdims=keepdims)
    values = svdvals(x)
    out = reductions.sum(values, axis=-1) if ord == "nuc" else reductions.max(values, axis=-1) if ord == 2 else reductions.min(values, axis=-1)
    return shaping.expand_dims(out, (-2, -1)) if keepdims else out


def _per_group(args: list[Tensor], core: int, fn, outs: list[tuple[tuple[int, ...], np.dtype]]) -> list[Tensor]:
    """Runs ``fn(*arrays) -> arrays`` on the last ``core`` axes, one group for each index of the others.

    One group's arrays are dense in one task, as the function needs them whole.
    """
    batch = np.broadcast_shapes(*[a.shape[: a.ndim - core] for a in args])
    keys = axis_names(len(batch))
    parts = None
    for k, a in enumerate(args):
        n = a.ndim - core
        a = shaping.broadcast_to(a, (*batch, *a.shape[n:])) if a.shape[:n] != batch else a
        cols = [F.col(f).alias(g) for f, g in zip(a.axes, (*keys, *[f"__c{j}" for j in range(core)]), strict=True)]
        v = F.col(VALUE)
        re, im = (v["re"], v["im"]) if T.is_complex(a.dtype) else (v.cast("double"), F.lit(0.0))
        part = a.df.select(*cols, F.lit(k).alias("__arg"), re.alias("__re"), im.alias("__im"))
        parts = part if parts is None else parts.unionByName(part)
    from ..relation import session

    grid = None  # groups without a stored cell exist too
    for f, n in zip(keys, batch, strict=True):
        axis = session().range(n).withColumnRenamed("id", f)
        grid = axis if grid is None else grid.crossJoin(axis)
    empty = (session().range(1).drop("id") if grid is None else grid).select(*keys, *[F.lit(0).cast("bigint").alias(f"__c{j}") for j in range(core)], F.lit(-1).alias("__arg"), F.lit(0.0).alias("__re"), F.lit(0.0).alias("__im"))
    parts = parts.unionByName(empty)
    by = list(keys) or ["__all"]
    parts = parts if keys else parts.withColumn("__all", F.lit(0))
    shapes, kinds, fills = [a.shape[a.ndim - core :] for a in args], [a.dtype for a in args], [a.fill_value for a in args]
    depth = builtins.max([len(s) for s, _ in outs] + [1])
    names = [f"__o{j}" for j in range(depth)]

    def run(key, pdf):
        import pandas as pd

        arrays = []
        for k, (shape, kind, fill) in enumerate(zip(shapes, kinds, fills, strict=True)):
            a = np.full(shape, fill, dtype=np.result_type(kind, np.float64) if kind.kind != "c" else np.complex128)
            mine = pdf[pdf["__arg"] == k]
            cells = mine["__re"].to_numpy() + (1j * mine["__im"].to_numpy() if kind.kind == "c" else 0)
            a[tuple(mine[f"__c{j}"].to_numpy() for j in range(core))] = cells
            arrays.append(a)
        rows = []
        for k, out in enumerate(fn(*arrays)):
            out = np.asarray(out)
            at = np.nonzero(np.ones_like(out, dtype=bool)) if out.ndim else ()
            flat = out.ravel() if out.ndim else out.reshape(1)
            frame = {"__arg": np.full(len(flat), k), "__re": flat.real.astype(float), "__im": flat.imag.astype(float)}
            for j, name in enumerate(names):
                frame[name] = at[j] if j < out.ndim else np.zeros(len(flat), dtype=np.int64)
            rows.append(pd.DataFrame(frame))
        got = pd.concat(rows)
        for f, value in zip(by, key, strict=True):
            got[f] = value
        return got

    schema = ", ".join(f"{f} {'bigint' if keys else 'int'}" for f in by) + ", __arg int, __re double, __im double, " + ", ".join(f"{n} bigint" for n in names)
    got = parts.groupBy(*by).applyInPandas(run, schema)
    if len(outs) > 1:
        got = got.persist()  # several results of one factorisation
    results = []
    for k, (shape, kind) in enumerate(outs):
        full = (*batch, *shape)
        v = F.struct(F.col("__re").alias("re"), F.col("__im").alias("im")) if T.is_complex(kind) else T.cast(F.col("__re"), T.float64, kind)
        cols = [F.col(f) for f in keys] + [F.col(n).alias(f"i{len(batch) + j}") for j, n in enumerate(names[: len(shape)])]
        df = got.where(F.col("__arg") == k).select(*cols, v.alias(VALUE))
        results.append(Tensor(Relation(df, axis_names(len(full)), dims_of(full), np.zeros((), kind)[()], kind).normal()))
    return results


def _kind(*args) -> np.dtype:
    kind = np.result_type(*[a.dtype for a in args])
    return kind if kind.kind in "fc" else T.float64


def _square(x) -> Tensor:
    x = promote(x)
    if x.ndim < 2 or x.shape[-1] != x.shape[-2]:
        raise ValueError("square matrices are needed")
    return x


def inv(x, /) -> Tensor:
    x = _square(x)
    return _per_group([x], 2, lambda a: [np.linalg.inv(a)], [(x.shape[-2:], _kind(x))])[0]


def cholesky(x, /, *, upper=False) -> Tensor:
    x = _square(x)
    return _per_group([x], 2, lambda a: [np.linalg.cholesky(a).conj().T if upper else np.linalg.cholesky(a)], [(x.shape[-2:], _kind(x))])[0]


def qr(x, /, *, mode="reduced") -> QRResult:
    x = promote(x)
    m, n = x.shape[-2:]
    k = builtins.min(m, n) if mode == "reduced" else m
    return QRResult(*_per_group([x], 2, lambda a: list(np.linalg.qr(a, mode=mode)), [((m, k), _kind(x)), ((k, n), _kind(x))]))


def _lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Partial pivoting: a == p @ l @ u."""
    m, n = a.shape
    u, order = a.astype(complex if a.dtype.kind == "c" else float), np.arange(m)
    k = builtins.min(m, n)
    low = np.zeros((m, k), dtype=u.dtype)
    for j in range(k):
        best = j + int(np.argmax(np.abs(u[j:, j])))
        if best != j:
            u[[j, best]], low[[j, best]], order[[j, best]] = u[[best, j]], low[[best, j]], order[[best, j]]
        low[j, j] = 1
        if u[j, j] != 0:
            low[j + 1 :, j] = u[j + 1 :, j] / u[j, j]
            u[j + 1 :] -= low[j + 1 :, j : j + 1] * u[j]
    p = np.zeros((m, m))
    p[order, np.arange(m)] = 1
    return p, low, np.triu(u[:k])


def lu(x, /, *, permute_l=False, p_indices=False):
    """P, L and U with partial pivoting; P as row numbers, or multiplied into L, if asked for."""
    x = promote(x)
    m, n = x.shape[-2:]
    k, kind = builtins.min(m, n), _kind(x)
    if permute_l:
        return tuple(_per_group([x], 2, lambda a: [(f := _lu(a))[0] @ f[1], f[2]], [((m, k), kind), ((k, n), kind)]))
    if p_indices:
        return LUResult(*_per_group([x], 2, lambda a: [np.argmax((f := _lu(a))[0], axis=1), f[1], f[2]], [((m,), T.int64), ((m, k), kind), ((k, n), kind)]))
    return LUResult(*_per_group([x], 2, lambda a: list(_lu(a)), [((m, m), T.float64), ((m, k), kind), ((k, n), kind)]))


def det(x, /) -> Tensor:
    x = _square(x)
    return _per_group([x], 2, lambda a: [np.linalg.det(a)], [((), _kind(x))])[0]


def slogdet(x, /) -> SlogdetResult:
    x = _square(x)
    real = T.float64 if _kind(x).kind == "c" else _kind(x)
    return SlogdetResult(*_per_group([x], 2, lambda a: list(np.linalg.slogdet(a)), [((), _kind(x)), ((), real)]))


def solve(x1, x2, /) -> Tensor:
    """x with x1 @ x = x2; x2 is a vector or a stack of matrices."""
    a, b = _square(x1), promote(x2)
    vector = b.ndim == 1
    b = shaping.expand_dims(b, 1) if vector else b
    out = _per_group([a, b], 2, lambda p, q: [np.linalg.solve(p, q)], [(b.shape[-2:], _kind(a, b))])[0]
    return shaping.squeeze(out, -1) if vector else out


def eigh(x, /, *, k=None, rtol=None, atol=None) -> EighResult:
    """Eigenvalues in rising order and vectors; with k, the k largest."""
    x = _square(x)
    n = x.shape[-1]
    take = n if k is None else k
    real = T.float64 if _kind(x).kind == "c" else _kind(x)

    def run(a):
        w, v = np.linalg.eigh(a)
        return [w[n - take :], v[:, n - take :]]

    return EighResult(*_per_group([x], 2, run, [((take,), real), ((n, take), _kind(x))]))


def eigvalsh(x, /, *, k=None, rtol=None, atol=None) -> Tensor:
    x = _square(x)
    n = x.shape[-1]
    take = n if k is None else k
    return _per_group([x], 2, lambda a: [np.linalg.eigvalsh(a)[n - take :]], [((take,), T.float64 if _kind(x).kind == "c" else _kind(x))])[0]


def svd(x, /, *, full_matrices=True, k=None, rtol=None, atol=None) -> SVDResult:
    x = promote(x)
    m, n = x.shape[-2:]
    r = builtins.min(m, n) if k is None else k
    whole = full_matrices and k is None
    real = T.float64 if _kind(x).kind == "c" else _kind(x)

    def run(a):
        u, s, v = np.linalg.svd(a, full_matrices=whole)
        return [u, s, v] if whole else [u[:, :r], s[:r], v[:r]]

    return SVDResult(*_per_group([x], 2, run, [((m, m if whole else r), _kind(x)), ((r,), real), ((n if whole else r, n), _kind(x))]))


def svdvals(x, /, *, k=None, rtol=None, atol=None) -> Tensor:
    x = promote(x)
    r = builtins.min(x.shape[-2:]) if k is None else k
    return _per_group([x], 2, lambda a: [np.linalg.svd(a, compute_uv=False)[:r]], [((r,), T.float64 if _kind(x).kind == "c" else _kind(x))])[0]


def pinv(x, /, *, rtol=None) -> Tensor:
    x = promote(x)
    m, n = x.shape[-2:]
    return _per_group([x], 2, lambda a: [np.linalg.pinv(a) if rtol is None else np.linalg.pinv(a, rtol=rtol)], [((n, m), _kind(x))])[0]


def matrix_rank(x, /, *, rtol=None, atol=None) -> Tensor:
    x = promote(x)
    size = builtins.max(x.shape[-2:])

    def run(a):
        s = np.linalg.svd(a, compute_uv=False)
        bound = builtins.max(atol or 0.0, (size * np.finfo(float).eps if rtol is None else rtol) * (s.max() if len(s) else 0.0))
        return [np.int64((s > bound).sum())]

    return _per_group([x], 2, run, [((), T.int64)])[0]


diagonal, trace, matrix_transpose = shaping.diagonal, shaping.trace, shaping.matrix_transpose
