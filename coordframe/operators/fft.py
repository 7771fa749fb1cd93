"""Discrete Fourier transforms: one grouped function per fibre or block."""

from __future__ import annotations

import numpy as np

from .. import types as T
from ..tensor import Tensor, asarray, normalize_axes, promote
from . import shaping
from .linalg import _per_group


def _resized(x: Tensor, n: int, axis: int) -> Tensor:
    """Cut or padded with zeros to n along an axis."""
    from .creation import zeros

    if x.shape[axis] >= n:
        return shaping.getitem(x, (*[slice(None)] * axis, slice(0, n)))
    shape = [n - x.shape[axis] if k == axis else m for k, m in enumerate(x.shape)]
    return shaping.concat([x, zeros(shape, dtype=x.dtype)], axis=axis)


def _one(name: str, out_size, real_out: bool = False):
    def transform(x, /, *, n=None, axis=-1, norm=None) -> Tensor:
        x = promote(x)
        axis = normalize_axes(axis, x.ndim)[0]
        size = x.shape[axis] if n is None else n
        length = out_size(x.shape[axis], n)
        if n is not None and name in ("fft", "ifft", "rfft", "ihfft"):
            x = _resized(x, size, axis)
        x = shaping.moveaxis(x, axis, -1)
        kind = T.float64 if real_out else T.complex128
        out = _per_group([x], 1, lambda a: [getattr(np.fft, name)(a, n=n, norm=norm or "backward")], [((length,), kind)])[0]
        return shaping.moveaxis(out, -1, axis)

    transform.__name__ = name
    transform.__doc__ = f"``{name}`` along one axis."
    return transform


fft = _one("fft", lambda m, n: n or m)
ifft = _one("ifft", lambda m, n: n or m)
rfft = _one("rfft", lambda m, n: (n or m) // 2 + 1)
irfft = _one("irfft", lambda m, n: n or 2 * (m - 1), True)
hfft = _one("hfft", lambda m, n: n or 2 * (m - 1), True)
ihfft = _one("ihfft", lambda m, n: (n or m) // 2 + 1)


def _axes(x, s, axes):
    x = promote(x)
    if axes is None:
        axes = tuple(range(x.ndim)) if s is None else tuple(range(x.ndim - len(s), x.ndim))
    axes = normalize_axes(tuple(axes), x.ndim)
    return x, axes, [None] * len(axes) if s is None else list(s)


def fftn(x, /, *, s=None, axes=None, norm=None) -> Tensor:
    x, axes, s = _axes(x, s, axes)
    for a, n in zip(axes, s, strict=True):
        x = fft(x, n=n, axis=a, norm=norm)
    return x


def ifftn(x, /, *, s=None, axes=None, norm=None) -> Tensor:
    x, axes, s = _axes(x, s, axes)
    for a, n in zip(axes, s, strict=True):
        x = ifft(x, n=n, axis=a, norm=norm)
    return x


def rfftn(x, /, *, s=None, axes=None, norm=None) -> Tensor:
    x, axes, s = _axes(x, s, axes)
    x = rfft(x, n=s[-1], axis=axes[-1], norm=norm)
    return fftn(x, s=None if s[0] is None else s[:-1], axes=axes[:-1], norm=norm) if len(axes) > 1 else x


def irfftn(x, /, *, s=None, axes=None, norm=None) -> Tensor:
    x, axes, s = _axes(x, s, axes)
    if len(axes) > 1:
        x = ifftn(x, s=None if s[0] is None else s[:-1], axes=axes[:-1], norm=norm)
    return irfft(x, n=s[-1], axis=axes[-1], norm=norm)


def fftshift(x, /, *, axes=None) -> Tensor:
    x = promote(x)
    axes = normalize_axes(axes, x.ndim)
    return shaping.roll(x, tuple(x.shape[a] // 2 for a in axes), axis=axes)


def ifftshift(x, /, *, axes=None) -> Tensor:
    x = promote(x)
    axes = normalize_axes(axes, x.ndim)
    return shaping.roll(x, tuple(-(x.shape[a] // 2) for a in axes), axis=axes)


def fftfreq(n, /, *, d=1.0, dtype=None, device=None) -> Tensor:
    return asarray(np.fft.fftfreq(n, d), dtype=dtype)


def rfftfreq(n, /, *, d=1.0, dtype=None, device=None) -> Tensor:
    return asarray(np.fft.rfftfreq(n, d), dtype=dtype)
