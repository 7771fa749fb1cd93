"""Index notation: ``einop`` statements and ``einsum`` subscripts, lowered to joins and grouped folds."""

from __future__ import annotations

import ast
import re
from collections import Counter

import numpy as np

from ..functions.registry import OPS
from ..plans.planner import contract
from ..relation import Relation, aggregate, map_join
from ..tensor import Tensor, promote

#: Spellings of the fold before ``=``.
FOLDS = {
    "": "overwrite",
    "+": "add",
    "add": "add",
    "sum": "add",
    "*": "multiply",
    "mul": "multiply",
    "prod": "multiply",
    "and": "logical_and",
    "all": "logical_and",
    "or": "logical_or",
    "any": "logical_or",
    "xor": "logical_xor",
    "min": "minimum",
    "minimum": "minimum",
    "max": "maximum",
    "maximum": "maximum",
    "&": "bitwise_and",
    "|": "bitwise_or",
    "^": "bitwise_xor",
    "logaddexp": "logaddexp",
    "choose": "choose",
}
_BINARY = {
    ast.Add: "add",
    ast.Sub: "subtract",
    ast.Mult: "multiply",
    ast.Div: "divide",
    ast.FloorDiv: "floor_divide",
    ast.Mod: "mod",
    ast.Pow: "power",
    ast.BitAnd: "bitwise_and",
    ast.BitOr: "bitwise_or",
    ast.BitXor: "bitwise_xor",
    ast.LShift: "bitwise_left_shift",
    ast.RShift: "bitwise_right_shift",
}
_COMPARE = {ast.Eq: "equal", ast.NotEq: "not_equal", ast.Lt: "less", ast.LtE: "less_equal", ast.Gt: "greater", ast.GtE: "greater_equal"}
_UNARY = {ast.USub: "negative", ast.UAdd: "positive", ast.Invert: "bitwise_invert", ast.Not: "logical_not"}
_STATEMENT = re.compile(r"^\s*(\w+)\s*(?:\[([^\]]*)\])?\s*([+*&|^]|[a-z]+)?=(?!=)\s*(.+?)\s*$", re.S)
#: Fold and map of the semirings whose products are planned.
_SEMIRINGS = {("add", "multiply"), ("logical_or", "logical_and"), ("minimum", "maximum"), ("maximum", "minimum"), ("logical_xor", "logical_and")}


def _factors(node: ast.expr, op: str) -> list[ast.expr]:
    """The factors of a product, flattened."""
    if isinstance(node, ast.BinOp) and _BINARY[type(node.op)] == op:
        return _factors(node.left, op) + _factors(node.right, op)
    if isinstance(node, ast.BoolOp) and op == ("logical_and" if isinstance(node.op, ast.And) else "logical_or"):
        return [f for v in node.values for f in _factors(v, op)]
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in OPS and OPS[node.func.id].name == op:
        return [f for v in node.args for f in _factors(v, op)]
    return [node]


class _Evaluator:
    def __init__(self, tensors: dict):
        self.tensors = tensors

    def tensor(self, name: str):
        if name not in self.tensors:
            raise ValueError(f"no tensor is named {name}")
        return self.tensors[name]

    def __call__(self, node: ast.expr):
        """A relation over index names, or a host scalar."""
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.Name):
            x = self.tensor(node.id)
            if not isinstance(x, Tensor) and np.ndim(x) == 0 and not hasattr(x, "shape"):
                return x
            x = promote(x)
            if x.ndim:
                raise ValueError(f"{node.id} has {x.ndim} axes but no indices")
            return x.labelled([])
        if isinstance(node, ast.Subscript):
            names = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
            if not isinstance(node.value, ast.Name) or not all(isinstance(n, ast.Name) for n in names):
                raise ValueError("an access is a name with index names")
            return promote(self.tensor(node.value.id)).labelled([n.id for n in names])
        if isinstance(node, ast.BinOp):
            return self.apply(_BINARY[type(node.op)], [node.left, node.right])
        if isinstance(node, ast.UnaryOp):
            return self.apply(_UNARY[type(node.op)], [node.operand])
        if isinstance(node, ast.BoolOp):
            return self.fold("logical_and" if isinstance(node.op, ast.And) else "logical_or", [self(v) for v in node.values])
        if isinstance(node, ast.Compare):  # a chain is a conjunction
            sides = [self(x) for x in (node.left, *node.comparators)]
            tests = [self.on(_COMPARE[type(op)], [a, b]) for op, a, b in zip(node.ops, sides, sides[1:], strict=False)]
            return self.fold("logical_and", tests)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            return self.apply(node.func.id, node.args)
        raise ValueError(f"{ast.unparse(node)} is no index expression")

    def fold(self, name: str, values: list):
        out = values[0]
        for v in values[1:]:
            out = self.on(name, [out, v])
        return out

    def apply(self, name: str, nodes: list):
        if name not in OPS:
            raise ValueError(f"no operator is named {name}")
        values = [self(n) for n in nodes]
        return self.fold(name, values) if len(values) > 2 and OPS[name].associative else self.on(name, values)

    @staticmethod
    def on(name: str, values: list):
        op = OPS[name]
        return map_join(op, values) if any(isinstance(v, Relation) for v in values) else op.value(*values)


def _result(rel, out: list[str]) -> Tensor:
    if not isinstance(rel, Relation):
        return promote(rel)
    return Tensor(rel.select(out, {}, rel.dims), [rel.dims[f] for f in out])


def einop(prgm: str, /, **tensors) -> Tensor:
    """One statement such as ``"C[i,j] += A[i,k] * B[k,j]"``; the fold runs over indices absent on the left.

    A plain ``=`` keeps the last cell along absent indices.  Repeated indices take the diagonal.
    """
    m = _STATEMENT.match(prgm)
    if not m:
        raise ValueError(f"{prgm!r} is no statement")
    out = [i.strip() for i in (m[2] or "").split(",") if i.strip()]
    word = m[3] or ""
    if word not in FOLDS:
        raise ValueError(f"{word} is no fold")
    fold = OPS[FOLDS[word]] if FOLDS[word] != "choose" else None
    node = ast.parse(m[4], mode="eval").body
    run = _Evaluator(tensors)
    if fold is not None:
        for a, b in _SEMIRINGS:
            if a == fold.name and len(parts := _factors(node, b)) > 1:
                values = [run(p) for p in parts]
                rels = [v for v in values if isinstance(v, Relation)]
                if len(rels) == len(values) and set(out) <= {f for r in rels for f in r.fields}:
                    return _result(contract(fold, OPS[b], rels, out), out)
    rel = run(node)
    if not isinstance(rel, Relation):
        return promote(rel)
    missing = [i for i in out if i not in rel.fields]
    if missing:
        raise ValueError(f"indices {missing} occur on the left only")
    drop = [f for f in rel.fields if f not in out]
    if fold is None:
        from ..functions.registry import choose

        fold = choose(rel.fill)
    if fold.name == "add" and rel.dtype == np.bool_:
        from .. import types as T

        rel = rel.normal(T.cast(rel.value, rel.dtype, T.int64), np.int64(rel.fill), T.int64)
    return _result(aggregate(fold, rel, drop), out)


def einop_program(prgm: str, /, **tensors) -> dict[str, Tensor]:
    """Several ``einop`` statements, one in a line or parted by semicolons; later ones see the results of earlier ones.

    Returns every result by name.  A name may be bound anew; empty lines and comments behind ``#`` don't count.
    """
    bound, made = dict(tensors), {}
    for line in re.split(r"[;\n]", prgm):
        line = line.partition("#")[0].strip()
        if line:
            m = _STATEMENT.match(line)
            if not m:
                raise ValueError(f"{line!r} is no statement")
            made[m[1]] = bound[m[1]] = einop(line, **bound)
    return made


def _labels(subscripts: str, args: list[Tensor]) -> tuple[list[list[str]], list[str]]:
    """Index names of each operand and of the result; an ellipsis may stand anywhere."""
    subscripts = subscripts.replace(" ", "")
    left, arrow, right = subscripts.partition("->")
    terms = left.split(",")
    if len(terms) != len(args):
        raise ValueError(f"{len(terms)} terms for {len(args)} operands")
    wide, names = 0, []
    for term, x in zip(terms, args, strict=True):
        n = x.ndim - len(term.replace("...", ""))
        if "..." in term:
            if n < 0:
                raise ValueError(f"{term} has too many indices")
            wide = max(wide, n)
        elif n:
            raise ValueError(f"{term} doesn't fit {x.ndim} axes")
    dots = [f"_{k}" for k in range(wide)]
    for term, x in zip(terms, args, strict=True):
        if "..." in term:
            a, b = term.split("...")
            n = x.ndim - len(a) - len(b)
            names.append([*a, *dots[wide - n :], *b])
        else:
            names.append(list(term))
    if arrow:
        a, dot, b = right.partition("...")
        return names, [*a, *(dots if dot else []), *b]
    count = Counter(c for term in terms for c in term.replace("...", ""))
    return names, [*dots, *sorted(c for c, k in count.items() if k == 1)]


def einsum(prgm, /, *args) -> Tensor:
    """NumPy's einsum: subscripts and operands, or operands with lists of index numbers."""
    if not isinstance(prgm, str):
        rest = [prgm, *args]
        out = rest.pop() if len(rest) % 2 else None

        def text(sub) -> str:
            return "".join("..." if k is Ellipsis else chr(ord("a") + k) if k < 26 else chr(ord("A") + k - 26) for k in sub)

        args = rest[0::2]
        prgm = ",".join(text(s) for s in rest[1::2]) + ("" if out is None else "->" + text(out))
    tensors = [promote(a) for a in args]
    names, out = _labels(prgm, tensors)
    sizes: dict[str, int] = {}
    for x, ns in zip(tensors, names, strict=True):
        for n, size in zip(ns, x.shape, strict=True):
            sizes[n] = max(sizes.get(n, 1), size)
    rels = []
    for x, ns in zip(tensors, names, strict=True):
        stretched = [n for n, size in zip(ns, x.shape, strict=True) if size == 1 and sizes[n] > 1]
        rel = x.labelled(ns)
        rels.append(rel.select([f for f in rel.fields if f not in stretched], {}, {}) if stretched else rel)
    if any(o not in sizes for o in out):
        raise ValueError("the result has an index that no operand has")
    got = contract(OPS["add"], OPS["multiply"], rels, out)
    return _result(got, out)
