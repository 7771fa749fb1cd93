"""The logical algebra as immutable nodes, and its lowering to DataFrames.

``Table, MapJoin, Aggregate, Reorder, Relabel`` are relational; ``Query, Produces, Plan`` are statements.
Each node infers its fields, sizes, element type and fill value without running anything.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from ..functions.registry import OPS, Op
from ..relation import Relation, aggregate, map_join
from ..tensor import Tensor, promote
from .planner import contract


class Node:
    """A relational expression."""

    def children(self) -> tuple[Node, ...]:
        return ()

    def lower(self, bound: Mapping[str, Relation]) -> Relation:
        raise NotImplementedError

    def fields(self, bound: Mapping[str, Relation] | None = None) -> tuple[str, ...]:
        return self.lower(bound or {}).fields

    def infer(self, bound: Mapping[str, Relation] | None = None) -> dict:
        """Fields, shape, element type and fill value."""
        rel = self.lower(bound or {})
        return {"fields": rel.fields, "shape": tuple(rel.dims[f] for f in rel.fields), "dtype": rel.dtype, "fill_value": rel.fill}


@dataclass(frozen=True)
class Literal(Node):
    """A constant."""

    value: object

    def lower(self, bound):
        from ..relation import scalar

        return scalar(self.value)


@dataclass(frozen=True)
class Field:
    """A named dimension."""

    name: str


@dataclass(frozen=True)
class Alias(Node):
    """A tensor bound by an earlier query."""

    name: str

    def lower(self, bound):
        if self.name not in bound:
            raise KeyError(f"{self.name} is not bound")
        return bound[self.name]


@dataclass(frozen=True)
class Table(Node):
    """A tensor, or a bound alias, with names for its dimensions."""

    tensor: object
    names: tuple[str, ...]

    def lower(self, bound):
        if isinstance(self.tensor, Alias):
            rel = self.tensor.lower(bound)
            return rel.relabel(dict(zip(rel.fields, self.names, strict=True)))
        return promote(self.tensor).labelled(self.names)


@dataclass(frozen=True)
class MapJoin(Node):
    """A pointwise operator over the arguments' common fields."""

    op: Op
    args: tuple[Node, ...]

    def children(self):
        return self.args

    def lower(self, bound):
        return map_join(self.op, [a.value if isinstance(a, Literal) else a.lower(bound) for a in self.args])


@dataclass(frozen=True)
class Aggregate(Node):
    """A fold of fields, ``init`` once for each cell."""

    op: Op
    init: object
    arg: Node
    drop: tuple[str, ...]

    def children(self):
        return (self.arg,)

    def lower(self, bound):
        product = self.arg
        if isinstance(product, MapJoin) and self.op.name in product.op.distributes_over and not any(isinstance(a, Literal) for a in product.args):
            rels = [a.lower(bound) for a in product.args]
            dims = [f for r in rels for f in r.fields]
            out = [f for f in dict.fromkeys(dims) if f not in self.drop]
            identity = self.init is None or self.init == self.op.identity
            return contract(self.op, product.op, rels, out, None if identity else self.init)
        return aggregate(self.op, self.arg.lower(bound), self.drop, self.init)


@dataclass(frozen=True)
class Reorder(Node):
    """Fields in another order; new ones have size one, and only such may be left out."""

    arg: Node
    names: tuple[str, ...]

    def children(self):
        return (self.arg,)

    def lower(self, bound):
        from pyspark.sql import functions as F

        rel = self.arg.lower(bound)
        if any(rel.dims[f] != 1 for f in rel.fields if f not in self.names):
            raise ValueError("only fields of size one can be dropped")
        new = {f: F.lit(0) for f in self.names if f not in rel.fields}
        return rel.select(self.names, new, dict.fromkeys(new, 1))


@dataclass(frozen=True)
class Relabel(Node):
    """Fields renamed by position."""

    arg: Node
    names: tuple[str, ...]

    def children(self):
        return (self.arg,)

    def lower(self, bound):
        rel = self.arg.lower(bound)
        return rel.relabel(dict(zip(rel.fields, self.names, strict=True)))


@dataclass(frozen=True)
class Query:
    """Binds an alias, or binds it anew."""

    name: str
    arg: Node


@dataclass(frozen=True)
class Produces:
    """The results; statements behind it don't count."""

    names: tuple[str, ...]


@dataclass(frozen=True)
class Plan:
    """Statements in order."""

    body: tuple = field(default=())

    def flat(self) -> tuple:
        """Nested plans opened, and everything behind the first Produces left out."""
        out: list = []
        for s in self.body:
            for x in s.flat() if isinstance(s, Plan) else (s,):
                out.append(x)
                if isinstance(x, Produces):
                    return tuple(out)
        return tuple(out)

    def run(self, **bound: Tensor) -> tuple[Tensor, ...]:
        """The produced tensors; unused queries are never executed, as DataFrames are lazy."""
        env = {k: promote(v).rel for k, v in bound.items()}
        for s in self.flat():
            if isinstance(s, Query):
                env[s.name] = merged(s.arg).lower(env)
            else:
                return tuple(Tensor(env[n]) for n in s.names)
        return ()


def merged(node: Node) -> Node:
    """Nested folds of one associative and commutative operator as one fold."""
    if isinstance(node, Aggregate):
        arg = merged(node.arg)
        if isinstance(arg, Aggregate) and arg.op is node.op and node.op.associative and node.op.commutative:
            plain = arg.init is None or arg.init == arg.op.identity
            if plain:
                return Aggregate(node.op, node.init, arg.arg, (*arg.drop, *node.drop))
        return Aggregate(node.op, node.init, arg, node.drop)
    if isinstance(node, MapJoin):
        args = []
        for a in map(merged, node.args):
            args.extend(a.args if isinstance(a, MapJoin) and a.op is node.op and node.op.associative else (a,))
        if len(args) > 2 and not any(isinstance(a, Literal) for a in args):
            out: Node = args[0]
            if node.op.distributes_over:
                return _Product(node.op, tuple(args))
            for a in args[1:]:
                out = MapJoin(node.op, (out, a))
            return out
        return MapJoin(node.op, tuple(args))
    if isinstance(node, (Reorder, Relabel)):
        return type(node)(merged(node.arg), node.names)
    return node


class _Product(MapJoin):
    """A flattened product: a fold above it is planned, without one it is joined in order."""

    def lower(self, bound):
        got = self.args[0].lower(bound)
        for a in self.args[1:]:
            got = map_join(self.op, [got, a.lower(bound)])
        return got


def op(name: str) -> Op:
    return OPS[name]
