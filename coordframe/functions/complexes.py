"""Elementary functions of complex numbers as expressions of their real and imaginary columns.

A complex column is a pair ``(re, im)`` of doubles here.  Branch cuts are those of NumPy, on both sides of them (signed zeros).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def _negative(x: Column) -> Column:
    return (x < 0) | (x.cast("string") == "-0.0")


def _signed(size: Column, sign: Column) -> Column:
    return F.when(_negative(sign), -F.abs(size)).otherwise(F.abs(size))


def _angle(re: Column, im: Column) -> Column:
    base = F.atan2(F.abs(im), F.abs(re))
    return _signed(F.when(_negative(re), F.lit(float(np.pi)) - base).otherwise(base), im)


def bound(x: Pair, f: Callable[[Pair], Pair]) -> Pair:
    """f of x, with x computed once: nested functions would otherwise repeat it in their generated code."""
    made = F.transform(F.array(struct(x)), lambda v: struct(f((v["re"], v["im"]))))[0]
    return made["re"], made["im"]


def struct(x: Pair) -> Column:
    return F.struct(x[0].cast("double").alias("re"), x[1].cast("double").alias("im"))


def add(x: Pair, y: Pair) -> Pair:
    return x[0] + y[0], x[1] + y[1]


def times(x: Pair, y: Pair) -> Pair:
    return x[0] * y[0] - x[1] * y[1], x[0] * y[1] + x[1] * y[0]


def scaled(x: Pair, by: float) -> Pair:
    return x[0] * by, x[1] * by


def exp(x: Pair) -> Pair:
    size = F.exp(x[0])
    return size * F.cos(x[1]), F.when(x[1] == 0, x[1]).otherwise(size * F.sin(x[1]))


def log(x: Pair) -> Pair:
    size = F.hypot(*x)
    return F.when(size == 0, F.lit(float("-inf"))).otherwise(F.ln(F.when(size == 0, 1.0).otherwise(size))), _angle(*x)


def sqrt(x: Pair) -> Pair:
    re, im = x
    big = F.sqrt((F.abs(re) + F.hypot(re, im)) / 2)
    small = F.when(big == 0, 0.0).otherwise(F.abs(im) / (2 * F.when(big == 0, 1.0).otherwise(big)))
    left = re < 0
    return F.when(left, small).otherwise(big), _signed(F.when(left, big).otherwise(small), im)


def sin(x: Pair) -> Pair:
    return F.sin(x[0]) * F.cosh(x[1]), F.cos(x[0]) * F.sinh(x[1])


def cos(x: Pair) -> Pair:
    return F.cos(x[0]) * F.cosh(x[1]), -F.sin(x[0]) * F.sinh(x[1])


def sinh(x: Pair) -> Pair:
    return F.sinh(x[0]) * F.cos(x[1]), F.cosh(x[0]) * F.sin(x[1])


def cosh(x: Pair) -> Pair:
    return F.cosh(x[0]) * F.cos(x[1]), F.sinh(x[0]) * F.sin(x[1])


def tanh(x: Pair) -> Pair:
    """sinh(2a) and sin(2b) over cosh(2a) + cos(2b); beyond 20, a is at its limit."""
    far = F.abs(x[0]) > 20
    a = F.when(far, 0.0).otherwise(2 * x[0])
    under = F.cosh(a) + F.cos(2 * x[1])
    return F.when(far, F.signum(x[0])).otherwise(F.sinh(a) / under), F.when(far, 0.0).otherwise(F.sin(2 * x[1]) / under)


def tan(x: Pair) -> Pair:
    """-i tanh(i x)."""
    re, im = tanh((-x[1], x[0]))
    return im, -re


def asinh(x: Pair) -> Pair:
    """The half with a positive real part, mirrored: there log(x + sqrt(1 + x x)) loses no digits."""
    left = _negative(x[0])
    half = F.abs(x[0]), F.when(left, -x[1]).otherwise(x[1])
    # 1 + x x by factors, so that the sign of its imaginary part is right on the cuts
    up, down = sqrt((1 - half[1], half[0])), sqrt((1 + half[1], -half[0]))
    re, im = bound(add(half, times(up, down)), log)
    return _signed(re, x[0]), _signed(im, x[1])


def asin(x: Pair) -> Pair:
    """-i asinh(i x)."""
    re, im = asinh((-x[1], x[0]))
    return im, -re


def acos(x: Pair) -> Pair:
    re, im = asin(x)
    return F.lit(float(np.pi / 2)) - re, -im


def acosh(x: Pair) -> Pair:
    """log(x + sqrt(x + 1) sqrt(x - 1))."""
    return bound(add(x, times(sqrt((x[0] + 1, x[1])), sqrt((x[0] - 1, x[1])))), log)


def atanh(x: Pair) -> Pair:
    """Half of log((1 + x) / (1 - x)), its two parts apart."""
    re, im = x
    near, far = (1 - re) * (1 - re) + im * im, (1 + re) * (1 + re) + im * im
    size = F.when(near == 0, F.lit(float("inf"))).when(far == 0, F.lit(float("-inf"))).otherwise((F.ln(F.when(far == 0, 1.0).otherwise(far)) - F.ln(F.when(near == 0, 1.0).otherwise(near))) / 4)
    return size, (_angle(1 + re, im) - _angle(1 - re, -im)) / 2


def atan(x: Pair) -> Pair:
    """-i atanh(i x)."""
    re, im = atanh((-x[1], x[0]))
    return im, -re


def log1p(x: Pair) -> Pair:
    return log((1 + x[0], x[1]))


def expm1(x: Pair) -> Pair:
    """(e**a - 1) cos(b) - 2 sin(b / 2)**2, which keeps small differences."""
    half = F.sin(x[1] / 2)
    return F.expm1(x[0]) * F.cos(x[1]) - 2 * half * half, F.exp(x[0]) * F.sin(x[1])


def sign(x: Pair) -> Pair:
    """x / |x|; zero has no direction."""
    size = F.hypot(*x)
    safe = F.when(size == 0, 1.0).otherwise(size)
    return x[0] / safe, x[1] / safe


def power(x: Pair, y: Pair) -> Pair:
    """exp(y log x); a zero to the power of zero is one, to any other power with a positive real part zero."""
    zero, none = F.hypot(*x) == 0, F.hypot(*y) == 0
    re, im = bound(log((F.when(zero, 1.0).otherwise(x[0]), x[1])), lambda v: exp(times(y, v)))
    bad = F.when(y[0] > 0, 0.0).otherwise(F.lit(float("nan")))
    return F.when(none, 1.0).when(zero, bad).otherwise(re), F.when(none, 0.0).when(zero, bad).otherwise(im)


_LN2, _LN10 = float(np.log(2.0)), float(np.log(10.0))
FUNCTIONS: dict[str, Callable[[Pair], Pair]] = {
    f.__name__: f for f in (sqrt, exp, expm1, log, log1p, sin, cos, tan, sinh, cosh, tanh, asin, acos, atan, asinh, acosh, atanh, sign)
}
FUNCTIONS["log2"] = lambda x: scaled(log(x), 1 / _LN2)
FUNCTIONS["log10"] = lambda x: scaled(log(x), 1 / _LN10)
