"""Tensor analytics on Spark: an array namespace over coordinate DataFrames.

``import coordframe as cf`` gives the functions of the Python array API, ``einsum`` and ``einop``
index notation, and reductions with any operator.  Everything is lazy until a value is asked for.
"""

import math as _math

from . import types as _types
from .functions import registry as ffuncs
from .operators import creation as _creation
from .operators import elementwise as _elementwise
from .operators import fft, linalg
from .operators import reductions as _reductions
from .operators import shaping as _shaping
from .operators.einsum import einop, einop_program, einsum
from .plans import ir, stats
from .plans.compute import LogicCapture, compute, cut, fuse, fused, jit, lazy, set_log_level
from .plans.planner import get_default_scheduler, set_default_scheduler, with_default_scheduler
from .plans.stats import BlockedStats, DCStats, DenseStats, DummyStats, FDStats, LPStats, UniformStats, VPStats, estimate
from .relation import Relation
from .sources.io import embedding_matrix, read_table, read_tensor, write_tensor
from .tensor import Tensor, asarray, from_coordinates, from_numpy, from_relation

__array_api_version__ = "2024.12"
pi, e, inf, nan, newaxis = _math.pi, _math.e, _math.inf, _math.nan, None

for _module, _names in (
    (_types, "bool_ int8 int16 int32 int64 uint8 uint16 uint32 uint64 float16 float32 float64 complex64 complex128 intp can_cast finfo iinfo isdtype result_type"),
    (_creation, "arange empty empty_like eye full full_like index_tensor linspace lower_triangle meshgrid one_hot ones ones_like parity_mask pattern repeat_tensor reshape_mask reverse_tensor roll_tensor upper_triangle zeros zeros_like"),
    (_elementwise, " ".join([*_elementwise.UNARY, *_elementwise.BINARY, "astype clip elementwise where"])),
    (_reductions, "all any argmax argmin argsort count_nonfill count_nonzero cumulative cumulative_prod cumulative_sum max max_by mean min min_by prod reduce searchsorted sort std sum var"),
    (_shaping, "broadcast_arrays broadcast_to concat diag diagonal diff expand_dims flip matrix_transpose moveaxis permute_dims repeat reshape roll squeeze stack take take_along_axis tile trace tril triu unstack"),
    (linalg, "matmul outer tensordot vecdot"),
):
    for _name in _names.split():
        globals()[_name] = getattr(_module, _name)

bool, float_, int_, complex_ = bool_, float64, int64, complex128  # noqa: F821
permute = permute_dims  # noqa: F821


def to_numpy(x, /):
    """A dense array on the driver."""
    return x.to_numpy() if hasattr(x, "to_numpy") else _types.np.asarray(x)


def to_scipy(x, /):
    """Coordinates on the driver as a SciPy sparse matrix, where SciPy is installed."""
    try:
        from scipy.sparse import coo_matrix
    except ImportError as error:
        raise TypeError("SciPy is not installed") from error
    x = asarray(x)
    if x.ndim != 2 or x.fill_value != 0:
        return coo_matrix(to_numpy(x))
    cells = x.to_df().toArrow()
    at = tuple(cells.column(f).to_numpy() for f in x.axes)
    values = [complex(v["re"], v["im"]) for v in cells.column("v").to_pylist()] if x.dtype.kind == "c" else cells.column("v").to_numpy()
    return coo_matrix((_types.np.asarray(values, dtype=x.dtype), at), shape=x.shape)


def fill_value(x, /):
    return asarray(x).fill_value


def element_type(x, /):
    return asarray(x).dtype


class _Info:
    """What the array API asks of a namespace."""

    def capabilities(self):
        return {"boolean indexing": False, "data-dependent shapes": False, "max dimensions": None}

    def default_device(self):
        return "spark"

    def devices(self):
        return ["spark"]

    def default_dtypes(self, *, device=None):
        return {"real floating": float64, "complex floating": complex128, "integral": int64, "indexing": intp}  # noqa: F821

    def dtypes(self, *, device=None, kind=None):
        names = [n for n in _types._STORAGE if n != "float16"]
        found = {n: _types.as_dtype(n) for n in names}
        return found if kind is None else {n: d for n, d in found.items() if _types.isdtype(d, kind)}


def __array_namespace_info__():
    return _Info()
