"""Deferred evaluation: DataFrames are lazy, so these keep the plan in one piece or cut it."""

from __future__ import annotations

import functools
import logging

from ..tensor import Tensor, promote
from .planner import LISTENERS


def lazy(x):
    """A deferred tensor, or a tuple of them: every tensor is one."""
    return tuple(map(promote, x)) if isinstance(x, tuple) else promote(x)


def compute(x):
    """Runs one tensor or a tuple of them; cells are cached until ``Tensor.unpersist``, so that shared work is done once."""
    many = tuple(map(promote, x)) if isinstance(x, (tuple, list)) else (promote(x),)
    for t in many:
        t.persist()
    for t in many:
        t.df.count()
    return many if isinstance(x, (tuple, list)) else many[0]


def cut(x: Tensor) -> Tensor:
    """The tensor with its lineage cut by a reliable checkpoint, for loops.

    Checkpoints go to the folder in ``spark.checkpoint.dir``.  Where none is set, Spark that runs in this process alone gets a
    temporary one; a cluster must name a folder that its machines share.
    """
    import tempfile
    from dataclasses import replace

    spark = x.df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="coordframe-"))
    return Tensor(replace(x.rel, df=x.df.checkpoint()), x.shape)


def fuse(f, *args, **kwargs):
    """f of deferred arguments, computed as one plan."""
    return compute(f(*map(lazy, args), **kwargs))


def fused(f):
    """A decorator: the function as one plan."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        return fuse(f, *args, **kwargs)

    return run


def jit(f=None, /, **_):
    """A decorator: plans stay deferred until Python asks for a value (in ``if``, ``while``, ``float()``)."""
    return fused(f) if f is not None else fused


class LogicCapture:
    """Records what is planned within it: each contraction's factors, order and cost (``steps``), and plans of tensors handed to ``add``.

    >>> with LogicCapture() as seen:
    ...     einsum("ij,jk,kl->il", a, b, c)
    >>> seen.steps[-1]["order"]
    """

    def __init__(self) -> None:
        self.steps: list[dict] = []
        self.plans: list[str] = []

    def __enter__(self) -> LogicCapture:
        self._token = LISTENERS.set((*LISTENERS.get(), self.steps.append))
        return self

    def __exit__(self, *_) -> None:
        LISTENERS.reset(self._token)

    def add(self, x: Tensor) -> None:
        """The plan of a tensor, as Spark explains it."""
        self.plans.append(x.df._jdf.queryExecution().toString())


def set_log_level(level, *stages: str) -> None:
    """The level of the package's loggers ``coordframe.<stage>`` (such as plan), or of all of them."""
    for name in [f"coordframe.{s}" for s in stages] or ["coordframe"]:
        logging.getLogger(name).setLevel(level)
