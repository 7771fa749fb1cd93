"""Tensors: relations whose fields are numbered axes, with the Python operators of arrays."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import types as T
from .relation import VALUE, Relation, session


def axis_names(n: int) -> tuple[str, ...]:
    return tuple(f"i{k}" for k in range(n))


class Tensor:
    """An n-dimensional array as a coordinate DataFrame ``(i0, i1, .., v)`` with shape, fill and dtype.

    Coordinates are unique; cells without a row hold the fill value.  Nothing runs until a value is
    asked for.
    """

    __array_priority__ = 1000
    device = "spark"

    def __init__(self, rel: Relation, shape: Sequence[int] | None = None):
        shape = tuple(rel.dims[f] for f in rel.fields) if shape is None else tuple(shape)
        names = axis_names(len(shape))
        self.rel = rel if rel.fields == names else rel.relabel(dict(zip(rel.fields, names, strict=True)))
        self.shape = shape

    @property
    def df(self) -> DataFrame:
        return self.rel.df

    @property
    def dtype(self) -> np.dtype:
        return self.rel.dtype

    element_type = dtype

    @property
    def fill_value(self):
        return self.rel.fill

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def axes(self) -> tuple[str, ...]:
        return self.rel.fields

    @property
    def T(self) -> Tensor:
        from .operators import shaping

        return shaping.permute_dims(self, tuple(reversed(range(self.ndim))))

    @property
    def mT(self) -> Tensor:
        from .operators import shaping

        return shaping.matrix_transpose(self)

    def labelled(self, names: Sequence[str]) -> Relation:
        """The relation with its axes renamed; equal names keep the diagonal."""
        names = tuple(names)
        if len(names) != self.ndim:
            raise ValueError(f"{self.ndim} axes need as many names, not {names}")
        rel = self.rel
        first: dict[str, str] = {}
        where, fields = None, []
        for axis, name in zip(self.axes, names, strict=True):
            if name in first:
                if rel.dims[first[name]] != rel.dims[axis]:
                    raise ValueError(f"sizes of {name} differ")
                test = F.col(first[name]) == F.col(axis)
                where = test if where is None else where & test
            else:
                first[name] = axis
                fields.append(axis)
        if where is not None:
            rel = rel.select(fields, {}, {}, where)
        return rel.relabel({axis: name for name, axis in first.items()})

    def to_df(self) -> DataFrame:
        """The stored cells."""
        return self.rel.df

    def to_numpy(self) -> np.ndarray:
        """A dense array on the driver."""
        out = np.full(self.shape, self.fill_value, dtype=self.dtype)
        table = self.rel.df.toArrow()
        values = table.column(VALUE)
        if T.is_complex(self.dtype):
            cells = [complex(x["re"], x["im"]) for x in values.to_pylist()]
        elif self.dtype == T.uint64:
            cells = [int(x) for x in values.to_pylist()]
        else:
            cells = values.to_numpy()
        cells = np.asarray(cells, dtype=self.dtype)
        if not self.ndim:
            return cells[0] + np.zeros((), self.dtype) if len(cells) else out
        out[tuple(table.column(f).to_numpy() for f in self.axes)] = cells
        return out

    def __array__(self, dtype=None, copy=None):
        out = self.to_numpy()
        return out if dtype is None else out.astype(dtype)

    def to_device(self, device, /, *, stream=None) -> Tensor:
        if stream is not None:
            raise ValueError("streams are not supported")
        return self

    def item(self):
        """The value of a one-cell tensor."""
        if self.size != 1:
            raise ValueError(f"a tensor of {self.size} cells is no scalar")
        row = self.rel.df.select(VALUE).first()
        if row is None:
            return np.asarray(self.fill_value).item()
        return complex(row[0]["re"], row[0]["im"]) if T.is_complex(self.dtype) else np.asarray(row[0]).astype(self.dtype).item()

    def persist(self) -> Tensor:
        """Caches the stored cells; both later plans and this one then share them."""
        self.rel.df.persist()
        return self

    def unpersist(self) -> Tensor:
        """Gives the cached cells back; later plans compute them anew."""
        self.rel.df.unpersist()
        return self

    def explain(self, mode: str = "formatted") -> None:
        self.rel.df.explain(mode)

    def __len__(self) -> int:
        if not self.shape:
            raise TypeError("a scalar has no length")
        return self.shape[0]

    def __bool__(self) -> bool:
        return bool(self.item())

    def __int__(self) -> int:
        return int(self.item())

    def __index__(self) -> int:
        if not T.is_integer(self.dtype):
            raise TypeError("only integers are indices")
        return int(self.item())

    def __float__(self) -> float:
        return float(self.item())

    def __complex__(self) -> complex:
        return complex(self.item())

    def __repr__(self) -> str:
        return f"Tensor(shape={self.shape}, dtype={self.dtype}, fill_value={self.fill_value!r})"

    def __array_namespace__(self, *, api_version=None):
        import coordframe

        return coordframe

    def __array_ufunc__(self, ufunc, method, *inputs, **kwargs):
        from .operators import elementwise, reductions

        if any(kwargs.get(k) is not None for k in ("out", "where", "casting", "order")):
            raise TypeError("out, where, casting and order are not supported")
        if method == "__call__":
            name = {"true_divide": "divide", "arctan2": "atan2", "absolute": "abs", "left_shift": "bitwise_left_shift", "right_shift": "bitwise_right_shift", "invert": "bitwise_invert", "rint": "round", "remainder": "mod"}.get(ufunc.__name__, ufunc.__name__)
            return elementwise.elementwise(name.replace("arc", "a") if name.startswith("arc") else name, *inputs)
        if method == "reduce":
            return reductions.reduce(ufunc.__name__, inputs[0], axis=kwargs.get("axis", 0), keepdims=kwargs.get("keepdims", False))
        return NotImplemented

    def __array_function__(self, func, types, args, kwargs):
        import coordframe

        found = getattr(coordframe, func.__name__, None)
        return NotImplemented if found is None else found(*args, **kwargs)

    def __getitem__(self, key):
        from .operators import shaping

        return shaping.getitem(self, key)

    def __setitem__(self, key, value) -> None:
        from .operators import shaping

        self.rel = shaping.setitem(self, key, value).rel


def _binary(name: str, swapped: bool = False):
    def method(self, other):
        from .operators.elementwise import elementwise

        return elementwise(name, other, self) if swapped else elementwise(name, self, other)

    return method


for _name, _op in {
    "add": "add",
    "sub": "subtract",
    "mul": "multiply",
    "truediv": "divide",
    "floordiv": "floor_divide",
    "mod": "mod",
    "pow": "power",
    "and": "bitwise_and",
    "or": "bitwise_or",
    "xor": "bitwise_xor",
    "lshift": "bitwise_left_shift",
    "rshift": "bitwise_right_shift",
}.items():
    setattr(Tensor, f"__{_name}__", _binary(_op))
    setattr(Tensor, f"__r{_name}__", _binary(_op, True))
for _name, _op in {"eq": "equal", "ne": "not_equal", "lt": "less", "le": "less_equal", "gt": "greater", "ge": "greater_equal"}.items():
    setattr(Tensor, f"__{_name}__", _binary(_op))
Tensor.__hash__ = object.__hash__


def _unary(name: str):
    def method(self):
        from .operators.elementwise import elementwise

        return elementwise(name, self)

    return method


for _name, _op in {"neg": "negative", "pos": "positive", "abs": "abs", "invert": "bitwise_invert"}.items():
    setattr(Tensor, f"__{_name}__", _unary(_op))


def _matmul(self, other):
    from .operators.linalg import matmul

    return matmul(self, other)


def _rmatmul(self, other):
    from .operators.linalg import matmul

    return matmul(other, self)


Tensor.__matmul__, Tensor.__rmatmul__ = _matmul, _rmatmul
Tensor.__divmod__ = lambda self, other: (self // other, self % other)
Tensor.__rdivmod__ = lambda self, other: (other // self, other % self)


def from_numpy(array, fill=None, dtype=None) -> Tensor:
    """A tensor from anything NumPy reads; cells equal to ``fill`` (default 0) are not stored."""
    a = np.asarray(array, dtype=dtype)
    if a.dtype.kind not in "biufc":
        raise TypeError(f"{a.dtype} is no element type")
    fill = np.zeros((), a.dtype)[()] if fill is None else np.asarray(fill).astype(a.dtype)[()]
    keep = ~((a == fill) | ((a != a) & (fill != fill)))
    if T.is_float(a.dtype) and fill == 0:
        keep |= np.signbit(a) != np.signbit(fill)
    at = np.nonzero(keep) if a.ndim else ()
    return _from_cells(at, a[keep] if a.ndim else (a.reshape(1) if keep else a.reshape(1)[:0]), a.shape, fill)


def _from_cells(at: Sequence[np.ndarray], values: np.ndarray, shape: Sequence[int], fill) -> Tensor:
    """A tensor of stored cells at distinct coordinates."""
    names, kind = axis_names(len(shape)), values.dtype
    columns = {f: pa.array(np.asarray(x, dtype=np.int64)) for f, x in zip(names, at, strict=True)}
    if T.is_complex(kind):
        columns[VALUE] = pa.StructArray.from_arrays([pa.array(values.real.astype(float)), pa.array(values.imag.astype(float))], names=["re", "im"])
    elif kind == T.uint64:
        columns[VALUE] = pa.array([int(x) for x in values], type=pa.decimal128(20, 0))
    elif kind.kind == "u":
        columns[VALUE] = pa.array(values.astype({1: np.int16, 2: np.int32, 4: np.int64}[kind.itemsize]))
    else:
        columns[VALUE] = pa.array(values.astype(np.float32) if kind == T.float16 else values)
    df = session().createDataFrame(pa.table(columns))
    return Tensor(Relation(df, names, dict(zip(names, shape, strict=True)), fill, kind))


def from_coordinates(at: Sequence, values, shape: Sequence[int], dtype=None, fill=0) -> Tensor:
    """A tensor from coordinate arrays on the driver, one for each axis; values at equal coordinates add up.  Nothing is densified."""
    values = np.asarray(values, dtype=dtype)
    at = [np.asarray(x, dtype=np.int64) for x in at]
    for x, n in zip(at, shape, strict=True):
        if len(x) and not (0 <= x.min() and x.max() < n):
            raise ValueError(f"a coordinate lies outside of {n}")
    fill = np.asarray(fill).astype(values.dtype)[()]
    if len(values) and at:
        order = np.lexsort(at[::-1])
        at, values = [x[order] for x in at], values[order]
        new = np.zeros(len(values), dtype=bool)
        new[0] = True
        for x in at:
            new[1:] |= x[1:] != x[:-1]
        first = np.flatnonzero(new)
        at, values = [x[first] for x in at], np.add.reduceat(values, first).astype(values.dtype)
    made = _from_cells(at, values, shape, fill)
    return Tensor(made.rel.normal())


def from_relation(df: DataFrame, index: Sequence[str], value: str | None, shape: Sequence[int], fill=0, dtype=None, reduce: str | None = "add") -> Tensor:
    """A tensor over a table: ``index`` columns are coordinates, ``value`` the cells (none: each row is a 1).

    Rows of equal coordinates are folded with ``reduce``; with None they must not occur.  Rows with a
    null coordinate or value are no cells.
    """
    from .functions.registry import OPS
    from .relation import _grouped, _product

    col = F.lit(1).cast("bigint") if value is None else F.col(value)
    names = axis_names(len(index))
    cells = df.select(*[F.col(c).cast("bigint").alias(n) for c, n in zip(index, names, strict=True)], col.alias(VALUE)).dropna()
    kind = T.from_spark(cells.schema[VALUE].dataType.simpleString())
    target = kind if dtype is None else T.as_dtype(dtype)
    cells = cells.select(*names, T.cast(F.col(VALUE), kind, target).alias(VALUE))
    rel = Relation(cells, names, dict(zip(names, shape, strict=True)), np.asarray(fill).astype(target)[()], target)
    if reduce == "multiply" and not T.is_float(target):
        rel = Relation(_product(cells, names, target, target).select(*names, VALUE), names, rel.dims, rel.fill, target)
    elif reduce is not None:
        rel = Relation(cells.groupBy(*names).agg(_grouped(OPS[reduce], target, target).alias(VALUE)), names, rel.dims, rel.fill, target)
    return Tensor(rel)


def asarray(obj, /, *, dtype=None, device=None, copy=None, format=None, fill=None) -> Tensor:
    """A tensor from a scalar, sequence, array, sparse array (row, col, data, or coords, data) or tensor.

    Sparse arrays keep their cells: nothing is densified.  ``format`` is kept for callers: every format is stored as coordinates.
    """
    if isinstance(obj, Tensor):
        if dtype is None or T.as_dtype(dtype) == obj.dtype:
            return obj
        from .operators.elementwise import astype

        return astype(obj, dtype)
    if all(hasattr(obj, a) for a in ("coords", "data", "shape")) and not hasattr(obj, "row"):
        return from_coordinates(list(obj.coords), obj.data, obj.shape, dtype, getattr(obj, "fill_value", 0))
    if hasattr(obj, "tocoo") or all(hasattr(obj, a) for a in ("row", "col", "data", "shape")):
        coo = obj.tocoo() if hasattr(obj, "tocoo") else obj
        return from_coordinates((coo.row, coo.col), coo.data, coo.shape, dtype)
    return from_numpy(obj, fill, dtype)


def promote(x) -> Tensor:
    return x if isinstance(x, Tensor) else asarray(x)


def shape_of(x) -> tuple[int, ...]:
    return tuple(x.shape) if hasattr(x, "shape") else np.shape(x)


def dims_of(shape: Sequence[int]) -> Mapping[str, int]:
    return dict(zip(axis_names(len(shape)), shape, strict=True))


def normalize_axes(axis, ndim: int) -> tuple[int, ...]:
    """Axes as non-negative numbers; None means all."""
    if axis is None:
        return tuple(range(ndim))
    axes = tuple(axis) if isinstance(axis, (tuple, list)) else (axis,)
    out = tuple(a + ndim if a < 0 else a for a in axes)
    if any(not 0 <= a < ndim for a in out):
        raise ValueError(f"axis {axis} is out of range for {ndim} axes")
    if len(set(out)) < len(out):
        raise ValueError(f"axes {axis} repeat")
    return out
