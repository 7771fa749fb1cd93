"""Contraction planning above Catalyst: which factors to join first and where to sum early.

Catalyst neither pushes a grouped sum below a join nor merges sums of sums, so the order of a product
of many factors is decided here, from estimated numbers of stored cells.
"""

from __future__ import annotations

import contextlib
import logging
import math
from collections.abc import Iterator, Mapping, Sequence
from contextvars import ContextVar
from dataclasses import dataclass

from ..functions.registry import Op
from ..relation import Relation, aggregate, map_join
from ..types import same
from .blocks import multiplied

#: naive: one join of all factors; greedy: the cheapest index first; exact: the cheapest order of all.
_STRATEGY: ContextVar[str] = ContextVar("strategy", default="exact")
EXACT_LIMIT = 12
#: A sum is taken at once if it leaves at most this share of the cells that it reads, by estimate.
SHRINK = 0.5
#: What is to be told of each contraction that is planned: LogicCapture listens here.
LISTENERS: ContextVar[tuple] = ContextVar("listeners", default=())
_LOG = logging.getLogger("coordframe.plan")


def get_default_scheduler() -> str:
    return _STRATEGY.get()


def set_default_scheduler(strategy: str) -> None:
    if strategy not in ("naive", "greedy", "exact"):
        raise ValueError("strategies are naive, greedy and exact")
    _STRATEGY.set(strategy)


@contextlib.contextmanager
def with_default_scheduler(strategy: str) -> Iterator[None]:
    before = _STRATEGY.get()
    set_default_scheduler(strategy)
    try:
        yield
    finally:
        _STRATEGY.set(before)


@dataclass(frozen=True)
class Size:
    """The estimated number of stored cells over some fields (uniform model: cells lie independently)."""

    fields: frozenset[str]
    nnz: float

    def density(self, dims: Mapping[str, int]) -> float:
        return min(1.0, self.nnz / max(1, math.prod(dims[f] for f in self.fields)))

    def join(self, other: Size, dims: Mapping[str, int]) -> Size:
        fields = self.fields | other.fields
        cells = math.prod(dims[f] for f in fields)
        return Size(fields, cells * self.density(dims) * other.density(dims))

    def union(self, other: Size, dims: Mapping[str, int]) -> Size:
        fields = self.fields | other.fields
        p, q = self.density(dims), other.density(dims)
        return Size(fields, math.prod(dims[f] for f in fields) * (p + q - p * q))

    def reduce(self, drop: frozenset[str], dims: Mapping[str, int]) -> Size:
        kept = self.fields - drop
        cells = math.prod(dims[f] for f in kept)
        n = math.prod(dims[f] for f in self.fields & drop)
        p = self.density(dims)
        return Size(kept, cells * (1.0 if p >= 1 else -math.expm1(n * math.log1p(-p))))


def stored(rel: Relation) -> float:
    """An upper bound on stored cells that needs no job: Catalyst's row estimate, or the dense size."""
    with contextlib.suppress(Exception):
        rows = rel.df._jdf.queryExecution().optimizedPlan().stats().rowCount()
        if rows.isDefined():
            return float(min(rel.size, int(str(rows.get()))))
    with contextlib.suppress(Exception):
        size = int(str(rel.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return float(min(rel.size, max(1, size // (8 * (len(rel.fields) + 2)))))
    return float(rel.size)


def _step(factors: Sequence[Size], index: str, out: frozenset[str], dims: Mapping[str, int]) -> tuple[list[int], frozenset[str], Size, float]:
    """Eliminating one index: the factors that hold it, all indices that end there, the result, and its cost."""
    used = [i for i, f in enumerate(factors) if index in f.fields]
    total = factors[used[0]]
    for i in used[1:]:
        total = total.join(factors[i], dims)
    # factors that lie inside the joined fields may come along for nothing
    for i, f in enumerate(factors):
        if i not in used and f.fields <= total.fields:
            total = total.join(f, dims)
            used.append(i)
    elsewhere = set(out).union(*[f.fields for i, f in enumerate(factors) if i not in used])
    gone = frozenset(total.fields - elsewhere)
    left = total.reduce(gone, dims)
    return sorted(used), gone, left, 10 * left.nnz + total.nnz


def order(sizes: Sequence[Size], out: Sequence[str], dims: Mapping[str, int], strategy: str | None = None) -> tuple[list[str], float]:
    """The indices in the order of elimination, and the estimated cost ``10 * written + joined`` cells."""
    strategy = strategy or _STRATEGY.get()
    keep = frozenset(out)
    inner = sorted({f for s in sizes for f in s.fields} - keep)

    def after(factors: list[Size], index: str) -> tuple[list[Size], float]:
        used, _, left, cost = _step(factors, index, keep, dims)
        return [f for i, f in enumerate(factors) if i not in used] + [left], cost

    def greedy(factors: list[Size]) -> tuple[list[str], float]:
        got, total = [], 0.0
        while todo := [i for i in inner if any(i in f.fields for f in factors)]:
            index = min(todo, key=lambda i: (after(factors, i)[1], i))
            factors, cost = after(factors, index)
            got.append(index)
            total += cost
        return got, total

    first = greedy(list(sizes))
    if strategy != "exact" or len(inner) > EXACT_LIMIT:
        return first
    # layers over sets of eliminated indices; nothing dearer than the greedy order is kept
    layer: dict[frozenset[str], tuple[float, list[str], list[Size]]] = {frozenset(): (0.0, [], list(sizes))}
    best = (first[1], first[0])
    while layer:
        following: dict[frozenset[str], tuple[float, list[str], list[Size]]] = {}
        for cost, done, factors in layer.values():
            todo = [i for i in inner if any(i in f.fields for f in factors)]
            if not todo and cost < best[0]:
                best = (cost, done)
            for i in todo:
                rest, more = after(factors, i)
                if cost + more > best[0]:
                    continue
                left = frozenset(x for f in rest for x in f.fields)
                key = frozenset(inner) - left
                if key not in following or cost + more < following[key][0]:
                    following[key] = (cost + more, [*done, i], rest)
        layer = following
    return best[1], best[0]


def contract(add: Op, mul: Op, factors: Sequence[Relation], out: Sequence[str], init=None) -> Relation:
    """``add`` over all indices not in ``out`` of the ``mul`` of the factors.

    Where ``mul`` distributes over ``add``, both are associative and commutative, and every factor's
    fill annihilates, sums are taken as soon as an index lies in no other factor and the sum is expected to leave fewer cells.  Otherwise, and for
    the naive strategy, the whole product is made first.
    """
    out = tuple(out)
    dims = {f: r.dims[f] for r in factors for f in r.fields}
    lawful = add.name in mul.distributes_over and add.associative and add.commutative and mul.associative and mul.commutative
    annihilate = mul.annihilator is not None and all(same(r.fill, mul.annihilator) for r in factors) and same(add.identity, mul.annihilator)
    drop = [f for f in dims if f not in out]

    def product(rels: Sequence[Relation]) -> Relation:
        got = rels[0]
        for r in rels[1:]:
            got = map_join(mul, [got, r])
        return got

    if not (lawful and annihilate) or _STRATEGY.get() == "naive" or len(factors) < 2:
        return aggregate(add, product(factors), drop, init)
    rels = list(factors)
    # an index that lies in one factor only is summed before any join
    for k, r in enumerate(rels):
        alone = [f for f in r.fields if f not in out and not any(f in o.fields for j, o in enumerate(rels) if j != k)]
        if alone:
            rels[k] = aggregate(add, r, alone)
    sizes = [Size(frozenset(r.fields), stored(r)) for r in rels]
    indices, cost = order(sizes, out, dims)
    step = {"fold": add.name, "map": mul.name, "factors": [(r.fields, s.nnz) for r, s in zip(rels, sizes, strict=True)], "out": out, "order": indices, "cost": cost}
    _LOG.debug("contraction %s", step)
    for listener in LISTENERS.get():
        listener(step)
    for index in indices:
        if not any(index in s.fields for s in sizes):
            continue
        used, gone, left, _ = _step(sizes, index, frozenset(out), dims)
        total = sizes[used[0]]
        for i in used[1:]:
            total = total.join(sizes[i], dims)
        apart = multiplied(*[rels[i] for i in used], sorted(gone), tuple(sizes[i].nnz for i in used), dims) if len(used) == 2 and (add.name, mul.name) == ("add", "multiply") else None
        joined = product([rels[i] for i in used]) if apart is None else apart
        if apart is not None:
            pass
        elif gone and left.nnz <= SHRINK * total.nnz:
            joined = aggregate(add, joined, sorted(gone))
        else:  # the sum would write about as many cells as it reads (keys that decide each other): a later one takes these indices along
            left = total
        rels = [r for i, r in enumerate(rels) if i not in used] + [joined]
        sizes = [s for i, s in enumerate(sizes) if i not in used] + [left]
    got = product(rels)
    rest = [f for f in got.fields if f not in out]
    if rest:
        return aggregate(add, got, rest, init)
    return got if init is None else aggregate(add, got.expand([*got.fields, "__one"], {**dims, "__one": 1}), ["__one"], init)
