"""Element types: NumPy dtypes as names, Spark types as storage, and NumPy's arithmetic on top.

Unsigned integers are stored in the next wider signed type (uint64 as decimal), float16 as float,
complex numbers as ``struct<re, im>``.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

bool_ = np.dtype("bool")
int8, int16, int32, int64 = (np.dtype(f"int{n}") for n in (8, 16, 32, 64))
uint8, uint16, uint32, uint64 = (np.dtype(f"uint{n}") for n in (8, 16, 32, 64))
float16, float32, float64 = (np.dtype(f"float{n}") for n in (16, 32, 64))
complex64, complex128 = np.dtype("complex64"), np.dtype("complex128")
intp = np.dtype("intp")

_STORAGE = {
    "bool": "boolean",
    "int8": "tinyint",
    "int16": "smallint",
    "int32": "int",
    "int64": "bigint",
    "uint8": "smallint",
    "uint16": "int",
    "uint32": "bigint",
    "uint64": "decimal(20,0)",
    "float16": "float",
    "float32": "float",
    "float64": "double",
    "complex64": "struct<re:double,im:double>",
    "complex128": "struct<re:double,im:double>",
}
_FROM_SPARK = {
    "boolean": bool_,
    "tinyint": int8,
    "smallint": int16,
    "int": int32,
    "bigint": int64,
    "float": float32,
    "double": float64,
    "decimal(20,0)": uint64,
    "struct<re:double,im:double>": complex128,
}


def as_dtype(kind) -> np.dtype:
    """A NumPy dtype from a dtype, a name, or Python's bool, int, float or complex."""
    return np.dtype(kind)


def storage(dtype: np.dtype) -> str:
    """The Spark type that holds a dtype."""
    try:
        return _STORAGE[as_dtype(dtype).name]
    except KeyError:
        raise TypeError(f"no Spark type holds {dtype}") from None


def from_spark(name: str) -> np.dtype:
    """The dtype of a Spark column type; other decimals count as float64."""
    if name in _FROM_SPARK:
        return _FROM_SPARK[name]
    if name.startswith("decimal"):
        return float64
    raise TypeError(f"{name} is no element type")


def is_integer(dtype: np.dtype) -> bool:
    return dtype.kind in "iu"


def is_float(dtype: np.dtype) -> bool:
    return dtype.kind == "f"


def is_complex(dtype: np.dtype) -> bool:
    return dtype.kind == "c"


def wrap(col: Column, dtype: np.dtype) -> Column:
    """An integer column of any width cut to ``dtype`` the way NumPy wraps around."""
    name = dtype.name
    if name == "int64":
        return col.cast("bigint")
    bits = dtype.itemsize * 8
    if name == "uint64":
        return F.pmod(col.cast("decimal(38,0)"), F.lit(Decimal(2**64)).cast("decimal(38,0)")).cast("decimal(20,0)")
    size = F.lit(1 << bits).cast("bigint")
    if dtype.kind == "u":
        return F.pmod(col.cast("bigint"), size).cast(storage(dtype))
    half = F.lit(1 << (bits - 1)).cast("bigint")
    return (F.pmod(F.pmod(col.cast("bigint"), size) + half, size) - half).cast(storage(dtype))


def wrapped_product(a: Column, b: Column) -> Column:
    """The product of two bigint columns modulo 2**64, whether or not Spark raises on overflow."""
    wide = a.cast("decimal(19,0)") * b.cast("decimal(19,0)")  # below 2**126, so it fits 38 digits
    low = F.pmod(wide, F.lit(Decimal(2**64)).cast("decimal(38,0)"))
    signed = F.when(low < F.lit(Decimal(2**63)), low).otherwise(low - F.lit(Decimal(2**64)))
    return F.coalesce(F.try_multiply(a, b), signed.cast("bigint"))


def cast(col: Column, source: np.dtype, target: np.dtype) -> Column:
    """NumPy's conversion: truncation toward zero, wrap-around, non-zero is true."""
    if source == target:
        return col
    if is_complex(target):
        if is_complex(source):
            return col
        return F.struct(cast(col, source, float64).alias("re"), F.lit(0.0).alias("im"))
    if is_complex(source):
        return cast(col["re"], float64, target)
    if target == bool_:
        return col != F.lit(0).cast(storage(source)) if source != bool_ else col
    if source == bool_:
        return col.cast("int").cast(storage(target))
    if is_integer(target):
        if is_float(source):
            whole = F.when(col < 0, F.ceil(col)).otherwise(F.floor(col))
            safe = F.when(F.isnan(col) | (F.abs(col) >= F.lit(2.0**63)), F.lit(-(2**63))).otherwise(whole)
            return wrap(safe, target)
        return wrap(col, target)
    if target == float16:
        return col.cast("float")
    return col.cast(storage(target))


def literal(value, dtype: np.dtype) -> Column:
    """A constant of the storage type."""
    dtype = as_dtype(dtype)
    if is_complex(dtype):
        value = complex(value)
        return F.struct(F.lit(value.real).alias("re"), F.lit(value.imag).alias("im"))
    if dtype == bool_:
        return F.lit(bool(value))
    if is_float(dtype):
        return F.lit(float(value)).cast(storage(dtype))
    return F.lit(int(value)).cast(storage(dtype))


def result_type(*args):
    """NumPy's promotion; Python scalars don't widen arrays."""
    return np.result_type(*[getattr(a, "dtype", a) for a in args])


def can_cast(source, target, /) -> bool:
    return np.can_cast(getattr(source, "dtype", source), target)


def isdtype(dtype, kind) -> bool:
    """Whether a dtype is of a kind: a dtype, one of the standard's names, or a tuple of these."""
    if isinstance(kind, tuple):
        return any(isdtype(dtype, k) for k in kind)
    kinds = {"bool": "b", "signed integer": "i", "unsigned integer": "u", "integral": "iu", "real floating": "f", "complex floating": "c", "numeric": "iufc"}
    dtype = as_dtype(dtype)
    return dtype.kind in kinds[kind] if isinstance(kind, str) and kind in kinds else dtype == as_dtype(kind)


def finfo(kind, /):
    return np.finfo(getattr(kind, "dtype", kind))


def iinfo(kind, /):
    return np.iinfo(getattr(kind, "dtype", kind))


def same(a, b) -> bool:
    """Equality of host values in which NaN equals NaN."""
    try:
        return bool(a == b) or (a != a and b != b)
    except (TypeError, ValueError):
        return False
