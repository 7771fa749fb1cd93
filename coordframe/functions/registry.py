"""The operator vocabulary: scalar expressions with NumPy's results, and their algebra.

An ``Op`` turns columns into a column, folds host values with NumPy (for fill values and result
types), and states the laws that the planner and the join rule use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import types as T
from . import complexes


@dataclass(frozen=True)
class Op:
    """``build(columns, dtypes, result dtype)`` makes the column; ``host`` computes on host values."""

    name: str
    host: Callable
    build: Callable
    associative: bool = False
    commutative: bool = False
    idempotent: bool = False
    identity: object = None
    annihilator: object = None
    distributes_over: frozenset = frozenset()
    result: Callable | None = field(default=None, compare=False)

    def dtype(self, *args) -> np.dtype:
        """The result's dtype, by NumPy's rules; Python scalars are weak."""
        if self.result is not None:
            return self.result(*args)
        probe = [np.ones(1, a) if isinstance(a, np.dtype) else a for a in args]
        with np.errstate(all="ignore"):
            return np.asarray(self.host(*probe)).dtype

    def value(self, *args):
        """The operator on host values."""
        with np.errstate(all="ignore"):
            return np.asarray(self.host(*args))[()]

    def __call__(self, *args):
        return self.value(*args)

    def __repr__(self) -> str:
        return f"Op({self.name})"

    def __reduce__(self):
        if OPS.get(self.name) is self:
            return (get, (self.name,))
        return (Op, tuple(getattr(self, f) for f in self.__dataclass_fields__))


OPS: dict[str, Op] = {}


def get(name: str) -> Op:
    return OPS[name]


def _add_op(name: str, host: Callable, build: Callable, **laws) -> Op:
    OPS[name] = Op(name, host, build, **laws)
    return OPS[name]


def nan() -> Column:
    return F.lit(float("nan"))


def inf(sign: int = 1) -> Column:
    return F.lit(sign * float("inf"))


def negative_sign(x: Column) -> Column:
    """True where the sign bit is set, for -0.0 too (NaN counts as positive)."""
    return (x < 0) & ~F.isnan(x) | (x.cast("string") == "-0.0")


def any_nan(*cols: Column) -> Column:
    out = F.isnan(cols[0])
    for c in cols[1:]:
        out = out | F.isnan(c)
    return out


def _common(cols, kinds, out):
    return [T.cast(c, k, out) for c, k in zip(cols, kinds, strict=True)]


def _double(cols, kinds):
    return [T.cast(c, k, T.float64) for c, k in zip(cols, kinds, strict=True)]


def _operand_type(kinds) -> np.dtype:
    out = np.result_type(*kinds)
    return T.float64 if out == T.float16 else out


def _arithmetic(real: Callable, complex_: Callable | None = None) -> Callable:
    """An arithmetic operator: integers in bigint and wrapped, floats in their type, complex by fields."""

    def build(cols, kinds, out):
        if T.is_complex(out):
            a, b = _common(cols, kinds, out)
            re, im = complex_(a["re"], a["im"], b["re"], b["im"])
            return F.struct(re.alias("re"), im.alias("im"))
        if T.is_integer(out):
            wide = "decimal(38,0)" if out == T.uint64 else "bigint"
            a, b = (c.cast(wide) for c in _common(cols, kinds, out))
            return T.wrap(real(a, b), out)
        if out == T.bool_:
            return T.cast(real(*[c.cast("int") for c in cols]), T.int32, T.bool_)
        return real(*_common(cols, kinds, out)).cast(T.storage(out))

    return build


def divide_float(a: Column, b: Column) -> Column:
    """IEEE division; a zero divisor gives an infinity or NaN, with signs."""
    at_zero = F.when(a == 0, nan()).when(negative_sign(a) != negative_sign(b), inf(-1)).otherwise(inf())
    return F.when(any_nan(a, b), nan()).when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def floor_float(x: Column) -> Column:
    """floor() that stays a double: values beyond 2**52, infinities and NaN are whole already."""
    small = F.abs(x) < 4503599627370496.0
    down = F.floor(F.when(small, x).otherwise(0.0)).cast("double")
    return F.when(small & (down != 0), down).when(small & negative_sign(x), F.lit(-0.0)).when(small, F.lit(0.0)).otherwise(x)


def _divide(cols, kinds, out):
    if T.is_complex(out):
        a, b = _common(cols, kinds, out)
        n = b["re"] * b["re"] + b["im"] * b["im"]
        re, im = a["re"] * b["re"] + a["im"] * b["im"], a["im"] * b["re"] - a["re"] * b["im"]
        return F.struct(divide_float(re, n).alias("re"), divide_float(im, n).alias("im"))
    return divide_float(*_double(cols, kinds)).cast(T.storage(out))


def _floor_int(a: Column, b: Column) -> Column:
    q = F.call_function("div", a, F.when(b == 0, F.lit(None)).otherwise(b))
    off = (a % F.when(b == 0, F.lit(None)).otherwise(b) != 0) & ((a < 0) != (b < 0))
    return F.coalesce(q - F.when(off, 1).otherwise(0), F.lit(0))


def _floor_divide(cols, kinds, out):
    if T.is_integer(out) or out == T.bool_:
        a, b = (T.cast(c, k, T.int64) for c, k in zip(cols, kinds, strict=True))
        return T.wrap(_floor_int(a, b), T.int8 if out == T.bool_ else out)
    a, b = _double(cols, kinds)
    return floor_float(divide_float(a, b)).cast(T.storage(out))


def _floor_divide_host(a, b):
    """Floors the IEEE quotient, so an infinite dividend stays infinite."""
    out = np.floor_divide(a, b)
    return np.floor(np.true_divide(a, b)).astype(out.dtype) if np.asarray(out).dtype.kind == "f" else out


def _mod(cols, kinds, out):
    if T.is_integer(out) or out == T.bool_:
        a, b = (T.cast(c, k, T.int64) for c, k in zip(cols, kinds, strict=True))
        return T.wrap(F.when(b == 0, F.lit(0)).otherwise(a - b * _floor_int(a, b)), T.int8 if out == T.bool_ else out)
    a, b = _double(cols, kinds)
    safe = F.when(b == 0, F.lit(None)).otherwise(b)
    r = a % safe
    moved = F.when((r != 0) & (negative_sign(r) != negative_sign(b)), r + b).when(r == 0, F.when(negative_sign(b), F.lit(-0.0)).otherwise(F.lit(0.0))).otherwise(r)
    far = F.when((F.abs(b) == inf()), F.when((a == 0) | (negative_sign(a) == negative_sign(b)), a).otherwise(b)).otherwise(moved)
    return F.when(any_nan(a, b) | (b == 0) | (F.abs(a) == inf()), nan()).otherwise(far).cast(T.storage(out))


def _power(cols, kinds, out):
    if T.is_complex(out):
        a, b = _common(cols, kinds, out)
        return complexes.struct(complexes.power((a["re"], a["im"]), (b["re"], b["im"])))
    if T.is_integer(out):
        a, b = (T.cast(c, k, T.int64) for c, k in zip(cols, kinds, strict=True))
        # by the exponent's bits; a square is only taken if a bit is left that needs it, so nothing overflows that the result doesn't
        start = F.struct(F.lit(1).cast("bigint").alias("total"), a.alias("square"), F.greatest(b, F.lit(0).cast("bigint")).alias("bits"))

        def step(s: Column, _: Column) -> Column:
            odd, more = s["bits"] % 2 == 1, s["bits"] > 1
            return F.struct(
                F.when(odd, s["total"] * s["square"]).otherwise(s["total"]).alias("total"),
                F.when(more, s["square"] * F.when(more, s["square"]).otherwise(1)).otherwise(s["square"]).alias("square"),
                F.shiftright(s["bits"], 1).alias("bits"),
            )

        return T.wrap(F.aggregate(F.sequence(F.lit(1), F.lit(63)), start, step)["total"], out)
    a, b = _double(cols, kinds)
    p = F.when(a == 1, F.lit(1.0)).when((a == -1) & (F.abs(b) == inf()), F.lit(1.0)).otherwise(F.pow(a, b))
    return p.cast(T.storage(out))


def _compare(test: Callable) -> Callable:
    """An IEEE comparison: NaN is unequal to all and never less or greater."""

    def build(cols, kinds, out):
        kind = _operand_type(kinds)
        if T.is_complex(kind):
            a, b = _common(cols, kinds, kind)
            return test(a, b)
        if kind == T.bool_:
            kind = T.int8
        a, b = _common(cols, kinds, kind)
        if not T.is_float(kind):
            return test(a, b)
        found = test(a, b)
        return F.when(any_nan(a, b), F.lit(test is _ne)).otherwise(found)

    return build


def _eq(a, b):
    return a == b


def _ne(a, b):
    return a != b


def _same(cols, kinds, out):
    return _eq_null(*_common(cols, kinds, _operand_type(kinds)))


def _eq_null(a, b):
    return a.eqNullSafe(b)


def _truth(cols, kinds):
    return [T.cast(c, k, T.bool_) for c, k in zip(cols, kinds, strict=True)]


def _extreme(pick: Callable) -> Callable:
    def build(cols, kinds, out):
        a, b = _common(cols, kinds, out)
        if out == T.bool_:
            return pick(a.cast("int"), b.cast("int")).cast("boolean")
        if T.is_float(out):
            return F.when(any_nan(a, b), nan().cast(T.storage(out))).otherwise(pick(a, b))
        return pick(a, b)

    return build


def _bits(word: str, truth: Callable) -> Callable:
    def build(cols, kinds, out):
        if out == T.bool_:
            return truth(*_truth(cols, kinds))
        a, b = (T.cast(c, k, T.int64) for c, k in zip(cols, kinds, strict=True))
        return T.wrap(getattr(a, word)(b), out)

    return build


def _shift(left: bool) -> Callable:
    def build(cols, kinds, out):
        a, b = (T.cast(c, k, T.int64) for c, k in zip(cols, kinds, strict=True))
        over = b >= out.itemsize * 8
        n = F.when(over, 0).otherwise(b).cast("int")
        if left:
            moved = F.when(over, 0).otherwise(F.call_function("shiftleft", a, n))
        else:
            moved = F.when(over, F.when(a < 0, -1).otherwise(0)).otherwise(F.call_function("shiftright", a, n))
        return T.wrap(moved.cast("bigint"), out)

    return build


def _unary(real: Callable, keep_int: bool = False, name: str = "") -> Callable:
    """A function of one number, complex ones by ``name``; integers are left alone if ``keep_int``."""

    def build(cols, kinds, out):
        if T.is_complex(kinds[0]):
            return complexes.struct(complexes.FUNCTIONS[name]((cols[0]["re"], cols[0]["im"])))
        if keep_int and (T.is_integer(kinds[0]) or kinds[0] == T.bool_):
            return T.cast(cols[0], kinds[0], out)
        return real(_double(cols, kinds)[0]).cast(T.storage(out))

    return build


def _log(fn: Callable, pole: float) -> Callable:
    def real(x: Column) -> Column:
        good = x > pole
        return F.when(F.isnan(x) | (x < pole), nan()).when(x == pole, inf(-1)).otherwise(fn(F.when(good, x).otherwise(F.lit(1.0))))

    return real


def _atan2(cols, kinds, out):
    a, b = _double(cols, kinds)
    base = F.atan2(F.abs(a), F.abs(b))
    turned = F.when(negative_sign(b), F.lit(np.pi) - base).otherwise(base)
    return F.when(any_nan(a, b), nan()).when(negative_sign(a), -turned).otherwise(turned).cast(T.storage(out))


def _logaddexp(cols, kinds, out):
    a, b = _double(cols, kinds)
    top = F.greatest(a, b)
    near = F.when(a == b, a + F.lit(float(np.log(2.0)))).otherwise(top + F.log1p(F.exp(-F.abs(a - b))))
    return F.when(any_nan(a, b), nan()).otherwise(near).cast(T.storage(out))




def _nextafter(cols, kinds, out):
    single = out == T.float32

    @F.pandas_udf("double")
    def step(a, b):
        import pandas as pd

        x, y = a.to_numpy(dtype="float64", na_value=np.nan), b.to_numpy(dtype="float64", na_value=np.nan)
        if single:
            x, y = x.astype("float32"), y.astype("float32")
        return pd.Series(np.nextafter(x, y).astype("float64"))

    return step(*_double(cols, kinds)).cast(T.storage(out))


def _sign_flip(cols, kinds, out):
    if T.is_complex(out):
        return F.struct((-cols[0]["re"]).alias("re"), (-cols[0]["im"]).alias("im"))
    if T.is_integer(out):
        return T.wrap(-T.cast(cols[0], kinds[0], T.int64), out)
    return -cols[0]


def _abs(cols, kinds, out):
    if T.is_complex(kinds[0]):
        return F.hypot(cols[0]["re"], cols[0]["im"])
    if T.is_integer(out):
        return T.wrap(F.abs(T.cast(cols[0], kinds[0], T.int64)), out)
    return F.abs(cols[0]) if T.is_float(out) else cols[0]


def _reciprocal(cols, kinds, out):
    if T.is_integer(out):
        x = T.cast(cols[0], kinds[0], T.int64)
        return T.wrap(F.when(F.abs(x) == 1, x).otherwise(0), out)
    return _divide([F.lit(1.0), cols[0]], [T.float64, kinds[0]], out)


def _sign(cols, kinds, out):
    x = cols[0]
    if T.is_complex(out):
        return complexes.struct(complexes.sign((x["re"], x["im"])))
    if T.is_float(out):
        return F.when(F.isnan(x), nan()).otherwise(F.signum(x.cast("double"))).cast(T.storage(out))
    return F.when(x > 0, 1).when(x < 0, -1).otherwise(0).cast(T.storage(out))


def _rounded(cols, kinds, out):
    return cols[0] if not T.is_float(out) else F.rint(cols[0].cast("double")).cast(T.storage(out))


def _trunc(x: Column) -> Column:
    return F.when(negative_sign(x), -floor_float(-x)).otherwise(floor_float(x))


def _where(cols, kinds, out):
    return F.when(T.cast(cols[0], kinds[0], T.bool_), T.cast(cols[1], kinds[1], out)).otherwise(T.cast(cols[2], kinds[2], out))


def _clip(cols, kinds, out):
    x, low, high = _common(cols, kinds, out)
    put = F.least(F.greatest(x, low), high)
    return F.when(any_nan(x, low, high), nan().cast(T.storage(out))).otherwise(put) if T.is_float(out) else put


def _square(cols, kinds, out):
    return OPS["multiply"].build([cols[0], cols[0]], [kinds[0], kinds[0]], out)


def _part(name: str) -> Callable:
    def build(cols, kinds, out):
        if T.is_complex(kinds[0]):
            return cols[0][name]
        return cols[0] if name == "re" else F.lit(0.0).cast(T.storage(out))

    return build


def _conj(cols, kinds, out):
    return F.struct(cols[0]["re"].alias("re"), (-cols[0]["im"]).alias("im")) if T.is_complex(out) else cols[0]


def _float_test(test: Callable, otherwise: bool) -> Callable:
    def build(cols, kinds, out):
        if T.is_complex(kinds[0]):
            a, b = test(cols[0]["re"]), test(cols[0]["im"])
            return a & b if otherwise else a | b
        return test(cols[0]) if T.is_float(kinds[0]) else F.lit(otherwise)

    return build


def _bool_result(*_):
    return T.bool_


def _first_type(*kinds):
    return kinds[0]


_add_op(
    "add", np.add, _arithmetic(lambda a, b: a + b, lambda a, b, c, d: (a + c, b + d)), associative=True, commutative=True, identity=0
)
_add_op("subtract", np.subtract, _arithmetic(lambda a, b: a - b, lambda a, b, c, d: (a - c, b - d)))
_add_op(
    "multiply",
    np.multiply,
    _arithmetic(lambda a, b: a * b, lambda a, b, c, d: (a * c - b * d, a * d + b * c)),
    associative=True,
    commutative=True,
    identity=1,
    annihilator=0,
    distributes_over=frozenset({"add"}),
)
_add_op("divide", np.true_divide, _divide)
_add_op("floor_divide", _floor_divide_host, _floor_divide)
_add_op("mod", np.mod, _mod)
_add_op("power", np.power, _power)
for _name, _fn, _np in (
    ("equal", _eq, np.equal),
    ("not_equal", _ne, np.not_equal),
    ("less", lambda a, b: a < b, np.less),
    ("less_equal", lambda a, b: a <= b, np.less_equal),
    ("greater", lambda a, b: a > b, np.greater),
    ("greater_equal", lambda a, b: a >= b, np.greater_equal),
):
    _add_op(_name, _np, _compare(_fn), commutative=_name in ("equal", "not_equal"), result=_bool_result)
_add_op("same", T.same, _same, commutative=True, result=_bool_result)
_add_op("not_same", lambda a, b: not T.same(a, b), lambda c, k, o: ~_same(c, k, o), commutative=True, result=_bool_result)
_add_op(
    "logical_and", np.logical_and, lambda c, k, o: _and(*_truth(c, k)), associative=True, commutative=True, idempotent=True, identity=True, annihilator=False, distributes_over=frozenset({"logical_or", "logical_xor"}), result=_bool_result
)
_add_op("logical_or", np.logical_or, lambda c, k, o: _or(*_truth(c, k)), associative=True, commutative=True, idempotent=True, identity=False, annihilator=True, distributes_over=frozenset({"logical_and"}), result=_bool_result)
_add_op("logical_xor", np.logical_xor, lambda c, k, o: _ne(*_truth(c, k)), associative=True, commutative=True, identity=False, result=_bool_result)
_add_op("logical_not", np.logical_not, lambda c, k, o: ~_truth(c, k)[0], result=_bool_result)
_add_op("truth", lambda x: np.asarray(x).astype(bool), lambda c, k, o: _truth(c, k)[0], result=_bool_result)


def _and(a, b):
    return a & b


def _or(a, b):
    return a | b


_add_op("bitwise_and", np.bitwise_and, _bits("bitwiseAND", _and), associative=True, commutative=True, idempotent=True, identity=-1, annihilator=0, distributes_over=frozenset({"bitwise_or", "bitwise_xor"}))
_add_op("bitwise_or", np.bitwise_or, _bits("bitwiseOR", _or), associative=True, commutative=True, idempotent=True, identity=0, distributes_over=frozenset({"bitwise_and"}))
_add_op("bitwise_xor", np.bitwise_xor, _bits("bitwiseXOR", _ne), associative=True, commutative=True, identity=0)
_add_op("bitwise_invert", np.invert, lambda c, k, o: ~c[0] if o == T.bool_ else T.wrap(F.bitwise_not(T.cast(c[0], k[0], T.int64)), o))
_add_op("bitwise_left_shift", np.left_shift, _shift(True))
_add_op("bitwise_right_shift", np.right_shift, _shift(False))
_add_op("minimum", np.minimum, _extreme(F.least), associative=True, commutative=True, idempotent=True, identity=float("inf"), distributes_over=frozenset({"maximum"}))
_add_op("maximum", np.maximum, _extreme(F.greatest), associative=True, commutative=True, idempotent=True, identity=float("-inf"), distributes_over=frozenset({"minimum"}))
_add_op("hypot", np.hypot, lambda c, k, o: F.hypot(*_double(c, k)).cast(T.storage(o)), commutative=True)
_add_op("atan2", np.arctan2, _atan2)
_add_op("logaddexp", np.logaddexp, _logaddexp, associative=True, commutative=True, identity=float("-inf"))
_add_op("copysign", np.copysign, lambda c, k, o: _copysign(*_double(c, k)).cast(T.storage(o)))
_add_op("nextafter", np.nextafter, _nextafter)


def _copysign(x, y):
    return F.when(negative_sign(y), -F.abs(x)).otherwise(F.abs(x))


_add_op("negative", np.negative, _sign_flip)
_add_op("positive", lambda x: np.asarray(x), lambda c, k, o: c[0], idempotent=True)
_add_op("identity", lambda x: np.asarray(x), lambda c, k, o: c[0], idempotent=True)
_add_op("abs", np.abs, _abs, idempotent=True)
_add_op("reciprocal", np.reciprocal, _reciprocal)
_add_op("square", np.square, _square)
_add_op("sign", np.sign, _sign)
_add_op("signbit", np.signbit, lambda c, k, o: negative_sign(_double(c, k)[0]), result=_bool_result)
_add_op("round", np.round, _rounded, idempotent=True)
_add_op("floor", np.floor, _unary(floor_float, True), idempotent=True)
_add_op("ceil", np.ceil, _unary(lambda x: -floor_float(-x), True), idempotent=True)
_add_op("trunc", np.trunc, _unary(_trunc, True), idempotent=True)
for _name, _fn in (
    ("sqrt", F.sqrt),
    ("exp", F.exp),
    ("expm1", F.expm1),
    ("sin", F.sin),
    ("cos", F.cos),
    ("tan", F.tan),
    ("sinh", F.sinh),
    ("cosh", F.cosh),
    ("tanh", F.tanh),
):
    _add_op(_name, getattr(np, _name), _unary(_fn, name=_name))
for _name, _np, _fn in (
    ("asin", np.arcsin, F.asin),
    ("acos", np.arccos, F.acos),
    ("atan", np.arctan, F.atan),
    ("asinh", np.arcsinh, F.asinh),
    ("acosh", np.arccosh, F.acosh),
    ("atanh", np.arctanh, F.atanh),
):
    _add_op(_name, _np, _unary(_fn, name=_name))
for _name, _fn, _pole in (("log", F.ln, 0.0), ("log2", F.log2, 0.0), ("log10", F.log10, 0.0), ("log1p", F.log1p, -1.0)):
    _add_op(_name, getattr(np, _name), _unary(_log(_fn, _pole), name=_name))
_add_op("isnan", np.isnan, _float_test(F.isnan, False), result=_bool_result)
_add_op("isinf", np.isinf, _float_test(lambda x: F.abs(x) == inf(), False), result=_bool_result)
_add_op("isfinite", np.isfinite, _float_test(lambda x: ~F.isnan(x) & (F.abs(x) != inf()), True), result=_bool_result)
_add_op("real", np.real, _part("re"), result=lambda k: np.real(np.ones(1, k)).dtype)
_add_op("imag", np.imag, _part("im"), result=lambda k: np.imag(np.ones(1, k)).dtype)
_add_op("conj", np.conj, _conj)
_add_op("iscomplexobj", np.iscomplexobj, lambda c, k, o: F.lit(T.is_complex(k[0])), result=_bool_result)
_add_op("where", np.where, _where, result=lambda c, a, b: np.result_type(a, b))
_add_op("clip", np.clip, _clip, result=_first_type)
_add_op("first_arg", lambda a, *_: a, lambda c, k, o: c[0], associative=True, result=_first_type)
_add_op("overwrite", lambda a, b: b, lambda c, k, o: c[1], associative=True, result=lambda a, b: b)
_add_op("divmod_quotient", _floor_divide_host, _floor_divide)
for _alias, _name in (("truediv", "divide"), ("remainder", "mod"), ("pow", "power"), ("arcsin", "asin"), ("arccos", "acos"), ("arctan", "atan"), ("arcsinh", "asinh"), ("arccosh", "acosh"), ("arctanh", "atanh"), ("min", "minimum"), ("max", "maximum")):
    OPS[_alias] = OPS[_name]


def choose(fill) -> Op:
    """Takes the first argument unless it is ``fill``: a fold that keeps the first stored value."""
    return Op(
        "choose",
        lambda a, b: b if T.same(a, fill) else a,
        lambda c, k, o: F.when(_same([c[0], T.literal(fill, k[0])], [k[0], k[0]], T.bool_), T.cast(c[1], k[1], o)).otherwise(T.cast(c[0], k[0], o)),
        associative=True,
        identity=fill,
        result=lambda a, b: np.result_type(a, b),
    )


def custom(name: str, host: Callable, **laws) -> Op:
    """A user operator from a NumPy function, run as an Arrow-batched pandas function."""

    def build(cols, kinds, out):
        @F.pandas_udf(T.storage(out))
        def run(*args):
            import pandas as pd

            with np.errstate(all="ignore"):
                return pd.Series(np.asarray(host(*[a.to_numpy() for a in args])).astype(out))

        return run(*cols)

    return Op(name, host, build, **laws)
