"""Relations with named axes: the algebra that every tensor operation is lowered to.

A relation holds the cells that differ from its fill value, one row each.  ``map_join`` and
``aggregate`` keep to this: whether a map becomes an inner, left or full outer join follows from the
fills, and reductions account for the cells that are not stored.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import types as T
from .functions.registry import OPS, Op, any_nan, nan, negative_sign

VALUE = "v"
#: Largest number of cells that broadcasting or densifying may make from implicit ones.
MAX_EXPANSION = 1 << 33


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


@dataclass(frozen=True)
class Relation:
    """``df`` has a bigint column for each field and a value column; cells without a row hold ``fill``."""

    df: DataFrame
    fields: tuple[str, ...]
    dims: Mapping[str, int]
    fill: object
    dtype: np.dtype

    @property
    def size(self) -> int:
        return math.prod(self.dims[f] for f in self.fields)

    @property
    def value(self) -> Column:
        return F.col(VALUE)

    def relabel(self, names: Mapping[str, str]) -> Relation:
        new = tuple(names.get(f, f) for f in self.fields)
        if len(set(new)) < len(new):
            raise ValueError("a relation's fields must differ")
        cols = [F.col(f).alias(g) for f, g in zip(self.fields, new, strict=True)]
        return replace(self, df=self.df.select(*cols, VALUE), fields=new, dims={g: self.dims[f] for f, g in zip(self.fields, new, strict=True)})

    def normal(self, col: Column | None = None, fill=None, dtype: np.dtype | None = None) -> Relation:
        """The relation with a new value column, without rows that hold the fill."""
        fill, dtype = (self.fill, self.dtype) if dtype is None else (fill, dtype)
        df = self.df if col is None else self.df.select(*self.fields, col.alias(VALUE))
        return replace(self, df=df.where(differs(F.col(VALUE), fill, dtype)), fill=fill, dtype=dtype)

    def select(self, fields: Sequence[str], exprs: Mapping[str, Column], dims: Mapping[str, int], where: Column | None = None) -> Relation:
        """New coordinates computed from the old ones."""
        df = self.df if where is None else self.df.where(where)
        df = df.select(*[exprs.get(f, F.col(f)).cast("bigint").alias(f) for f in fields], VALUE)
        return replace(self, df=df, fields=tuple(fields), dims={f: dims.get(f, self.dims.get(f)) for f in fields})

    def expand(self, fields: Sequence[str], dims: Mapping[str, int]) -> Relation:
        """Every stored cell at each coordinate of the fields that it lacks."""
        out, df = self, self.df
        more = [f for f in fields if f not in self.fields]
        grown = math.prod([dims[f] for f in more]) if more else 1
        if more and grown * max(1, self.size) > MAX_EXPANSION:
            raise ValueError(f"broadcasting over {more} would make more than {MAX_EXPANSION} cells")
        for f in more:  # one long column for each coordinate; broadcast by Spark if it is small
            df = df.crossJoin(session().range(dims[f]).withColumnRenamed("id", f))
        return replace(out, df=df.select(*fields, VALUE), fields=tuple(fields), dims={**self.dims, **{f: dims[f] for f in more}}) if more else self

    def dense(self, over: Sequence[str] | None = None) -> Relation:
        """A row for each cell; with ``over``, only along these fields of fibres that hold a row."""
        over = self.fields if over is None else tuple(over)
        kept = [f for f in self.fields if f not in over]
        if not self.fields:
            one = session().range(1).select(T.literal(self.fill, self.dtype).alias("__f"))
            return replace(self, df=one.join(self.df, F.lit(True), "left").select(F.coalesce(VALUE, "__f").alias(VALUE)))
        if math.prod(self.dims[f] for f in over) > MAX_EXPANSION:  # of each fibre, if some fields are kept
            raise ValueError(f"{math.prod(self.dims[f] for f in over)} dense cells are more than {MAX_EXPANSION}")
        grid = self.df.select(*kept).distinct() if kept else None
        for f in over:
            axis = session().range(self.dims[f]).withColumnRenamed("id", f)
            grid = axis if grid is None else grid.crossJoin(axis)
        df = grid.join(self.df, list(self.fields), "left")
        return replace(self, df=df.select(*self.fields, F.coalesce(VALUE, T.literal(self.fill, self.dtype)).alias(VALUE)))


def differs(col: Column, fill, dtype: np.dtype) -> Column:
    """Whether a value is not the fill; zeros of different sign differ."""
    f = T.literal(fill, dtype)
    if T.is_float(dtype) and fill == 0:
        return ~col.eqNullSafe(f) | (negative_sign(col) != F.lit(bool(np.signbit(fill))))
    return ~col.eqNullSafe(f)


def scalar(value, dtype: np.dtype | None = None) -> Relation:
    """A relation without fields or rows: the fill is the value."""
    dtype = np.asarray(value).dtype if dtype is None else dtype
    return Relation(session().range(0).select(T.literal(value, dtype).alias(VALUE)), (), {}, value, dtype)


def _kind(arg) -> np.dtype:
    return arg.dtype if isinstance(arg, Relation) else np.asarray(arg).dtype


def _fill_as(value, dtype: np.dtype):
    with np.errstate(all="ignore"):
        return np.asarray(value).astype(dtype)[()]


def map_join(op: Op, args: Sequence, fields: Sequence[str] | None = None) -> Relation:
    """The operator at each coordinate of the arguments' common fields.

    Arguments are relations and host scalars.  Relations whose fill annihilates the operator are
    joined inner, as no other cell can differ from the result's fill; then the rest joins left.  Without such
    arguments cells of any argument count, and the join is a full outer one.
    """
    rels = [a for a in args if isinstance(a, Relation)]
    dims: dict[str, int] = {}
    for r in rels:
        for f in r.fields:
            if dims.setdefault(f, r.dims[f]) != r.dims[f]:
                raise ValueError(f"sizes {dims[f]} and {r.dims[f]} of {f} differ")
    fields = tuple(dims) if fields is None else tuple(fields)
    kinds = [_kind(a) for a in args]
    out = op.dtype(*[a.dtype if isinstance(a, Relation) else a for a in args])
    fill = _fill_as(op.value(*[a.fill if isinstance(a, Relation) else a for a in args]), out)

    def finish(df: DataFrame, values: Sequence[Column]) -> Relation:
        col = op.build(list(values), kinds, out)
        made = Relation(df.select(*fields, col.alias(VALUE)), fields, {f: dims[f] for f in fields}, fill, out)
        return made.normal()

    constants = {i: T.literal(a, kinds[i]) for i, a in enumerate(args) if not isinstance(a, Relation)}
    if all(r.df is rels[0].df and r.fields == rels[0].fields for r in rels):
        return finish(rels[0].df, [constants.get(i, F.col(VALUE)) for i in range(len(args))])

    named = {i: f"__v{i}" for i, a in enumerate(args) if isinstance(a, Relation)}

    def ready(i: int, rel: Relation) -> DataFrame:
        return rel.df.select(*rel.fields, F.col(VALUE).alias(named[i]))

    inner = [i for i in named if op.annihilator is not None and T.same(args[i].fill, op.annihilator)]
    if inner:
        have: tuple[str, ...] = ()
        df = None
        for i in inner:
            df, have = (ready(i, args[i]), args[i].fields) if df is None else natural(df, have, ready(i, args[i]), args[i].fields)
        missing = [f for f in fields if f not in have]
        size = math.prod([dims[f] for f in missing])
        if missing and size * math.prod([dims[f] for f in have] or [1]) > MAX_EXPANSION:
            raise ValueError(f"broadcasting over {missing} would make more than {MAX_EXPANSION} cells")
        for f in missing:
            df = df.crossJoin(session().range(dims[f]).withColumnRenamed("id", f))
        others = [i for i in named if i not in inner]
        for i in others:
            on = list(args[i].fields)
            df = df.join(ready(i, args[i]), on, "left") if on else df.join(ready(i, args[i]), F.lit(True), "left")
    else:
        df, others = None, list(named)
        for i in named:
            part = ready(i, args[i].expand(fields, dims))
            if df is None:
                df = part
            else:
                df = df.join(part, list(fields), "full") if fields else df.join(part, F.lit(True), "full")
    values = []
    for i, a in enumerate(args):
        if i in constants:
            values.append(constants[i])
        elif i in others:
            values.append(F.coalesce(F.col(named[i]), T.literal(a.fill, a.dtype)))
        else:
            values.append(F.col(named[i]))
    return finish(df, values)


def natural(a: DataFrame, a_fields: tuple[str, ...], b: DataFrame, b_fields: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...]]:
    """The natural join and its fields; without common fields, the product."""
    on = [f for f in a_fields if f in b_fields]
    joined = a.join(b, on, "inner") if on else a.crossJoin(b)
    return joined, a_fields + tuple(f for f in b_fields if f not in a_fields)


def repeated(op: Op, value, n: int):
    """``value`` folded with itself ``n`` times (n > 0)."""
    if op.idempotent or op.name in ("choose", "first_arg", "overwrite"):
        return value
    if n >= 1 << 63 and op.name in ("add", "multiply") and np.asarray(value).dtype.kind in "iu":  # n is no int64
        kind, whole = np.asarray(value).dtype, int(value) * n if op.name == "add" else pow(int(value), n, 1 << 64)
        return np.uint64(whole % (1 << 64)).astype(kind)
    with np.errstate(all="ignore"):
        if op.name == "add":
            return value * n
        if op.name == "multiply":
            return value**n
        if op.name == "logical_xor":
            return bool(value) and n % 2 == 1
        if op.name == "bitwise_xor":
            return value if n % 2 else value ^ value
        if op.name == "logaddexp":
            return value + math.log(n)
    out = value
    for _ in range(n - 1):
        out = op.value(out, value)
    return out


def _exact_product(dtype: np.dtype) -> Column:
    """An integer product modulo 2**64 as a single aggregate, for streams; it lists a group's factors beside 0, 1 and -1."""
    v = T.cast(F.col(VALUE), dtype, T.int64)
    parts = F.collect_list(F.when((v != 1) & (v != -1) & (v != 0), v))
    signs = F.count_if(v == -1) % 2
    fold = F.aggregate(parts, F.lit(1).cast("bigint"), T.wrapped_product)
    return F.when(F.count_if(v == 0) > 0, F.lit(0).cast("bigint")).otherwise(fold * F.when(signs == 1, -1).otherwise(1))


#: A group's product is folded in as many parts, so that no list of a group's values grows with the group alone.
PRODUCT_PARTS = 1 << 12


def _product(df: DataFrame, kept: Sequence[str], dtype: np.dtype, out: np.dtype) -> DataFrame:
    """Each group's product, integers modulo 2**64 or complex numbers, with the number of its cells (``__n``)."""
    wide = T.complex128 if T.is_complex(out) else T.int64
    multiply = OPS["multiply"]

    def fold(values: Column) -> Column:
        return F.aggregate(values, T.literal(1, wide), (lambda x, y: multiply.build([x, y], [wide, wide], wide)) if T.is_complex(out) else T.wrapped_product)

    v = T.cast(F.col(VALUE), dtype, wide)
    part = F.pmod(F.monotonically_increasing_id(), F.lit(PRODUCT_PARTS)).alias("__part")
    parts = df.select(*kept, v.alias(VALUE), part).groupBy(*kept, "__part").agg(fold(F.collect_list(VALUE)).alias(VALUE), F.count("*").alias("__n"))
    whole = parts.groupBy(*kept).agg(F.collect_list(VALUE).alias("__all"), F.sum("__n").alias("__n"))
    product = fold(F.col("__all"))
    return whole.select(*kept, (product if T.is_complex(out) else T.wrap(product, out)).alias(VALUE), "__n")


def _grouped(op: Op, dtype: np.dtype, out: np.dtype) -> Column | None:
    """The Spark aggregate of an operator over the stored values."""
    v = F.col(VALUE)
    name = op.name
    if name == "add":
        if T.is_complex(dtype):
            return F.struct(F.sum(v["re"]).alias("re"), F.sum(v["im"]).alias("im"))
        return F.sum(T.cast(v, dtype, out if T.is_integer(out) and out != T.uint64 else T.float64 if T.is_float(out) else out)).cast(T.storage(out))
    if name == "multiply" and not T.is_complex(dtype):
        return F.product(v.cast("double")).cast(T.storage(out)) if T.is_float(out) else T.wrap(_exact_product(dtype), out)
    if name in ("minimum", "maximum"):
        pick = F.min if name == "minimum" else F.max
        if dtype == T.bool_:
            return pick(v.cast("int")).cast("boolean")
        return F.when(F.bool_or(any_nan(v)), nan().cast(T.storage(out))).otherwise(pick(v)) if T.is_float(dtype) else pick(v)
    if name == "logical_and":
        return F.bool_and(T.cast(v, dtype, T.bool_))
    if name == "logical_or":
        return F.bool_or(T.cast(v, dtype, T.bool_))
    if name == "logical_xor":
        return F.count_if(T.cast(v, dtype, T.bool_)) % 2 == 1
    if name.startswith("bitwise_") and name[8:] in ("and", "or", "xor"):
        if dtype == T.bool_:
            return {"and": F.bool_and(v), "or": F.bool_or(v), "xor": F.count_if(v) % 2 == 1}[name[8:]]
        return {"and": F.bit_and, "or": F.bit_or, "xor": F.bit_xor}[name[8:]](v)
    if name == "logaddexp":
        x = T.cast(v, dtype, T.float64)
        return F.log(F.sum(F.exp(x)))
    return None


def aggregate(op: Op, rel: Relation, drop: Sequence[str], init=None, out: np.dtype | None = None) -> Relation:
    """Folds the fields in ``drop``; ``init`` enters once for each result cell.

    Cells that are not stored enter as repeated fills.  Operators without a Spark aggregate are
    folded in row-major order, one group at a time, with the host function.
    """
    drop = [f for f in rel.fields if f in drop]
    kept = tuple(f for f in rel.fields if f not in drop)
    dims = {f: rel.dims[f] for f in kept}
    out = rel.dtype if out is None else out
    n = math.prod(rel.dims[f] for f in drop)
    if not drop:
        return rel.normal(T.cast(rel.value, rel.dtype, out), _fill_as(rel.fill, out), out) if out != rel.dtype else rel
    fill = _fill_as(rel.fill, out)
    empty = op.identity if init is None else init
    if n:
        whole = repeated(op, fill, n)
        whole = whole if init is None else op.value(init, whole)
    else:
        whole = empty
    if whole is None:
        raise ValueError(f"{op.name} of no cells has no value without init")
    whole = _fill_as(whole, out)
    if n == 0:
        return Relation(rel.df.limit(0).select(*kept, T.literal(whole, out).alias(VALUE)), kept, dims, whole, out)
    implicit = not (op.identity is not None and T.same(fill, _fill_as(op.identity, out) if op.identity is not None and not isinstance(op.identity, float) else op.identity))
    if op.name == "choose":
        implicit = False
    found = _grouped(op, rel.dtype, out)
    source = rel
    if op.name == "logaddexp":  # shifted by the group's largest value
        top = rel.df.groupBy(*kept).agg(F.max(F.when(F.isnan(VALUE), None).otherwise(F.col(VALUE))).alias("__m"))
        joined = rel.df.join(top, list(kept)) if kept else rel.df.crossJoin(top)
        shift = F.when(F.abs(F.col("__m")) == float("inf"), 0.0).otherwise(F.coalesce("__m", F.lit(0.0)))
        df = joined.groupBy(*kept).agg((F.log(F.sum(F.exp(F.col(VALUE) - shift))) + F.max(shift)).alias(VALUE), F.count("*").alias("__n"))
    elif op.name == "multiply" and not T.is_float(out):
        df = _product(source.df, kept, rel.dtype, out)
    elif found is not None:
        df = source.df.groupBy(*kept).agg(found.alias(VALUE), F.count("*").alias("__n"))
    elif op.name in ("choose", "first_arg", "overwrite"):
        order = F.struct(*drop)
        pick = F.max_by if op.name == "overwrite" else F.min_by
        if op.name != "choose":
            source, implicit = rel.dense(drop), False
        df = source.df.groupBy(*kept).agg(pick(VALUE, order).alias(VALUE), F.count("*").alias("__n"))
    else:
        source, implicit = rel.dense(drop), False
        df = _host_fold(op, source, kept, drop, out)
    if implicit:
        df = df.withColumn(VALUE, _with_fills(op, F.col(VALUE), F.lit(n if n < 1 << 63 else Decimal(n)) - F.col("__n"), fill, out))
    if init is not None:
        df = df.withColumn(VALUE, op.build([T.literal(init, out), F.col(VALUE)], [out, out], out))
    if not kept:
        df = df.select(F.coalesce(F.col(VALUE), T.literal(whole, out)).alias(VALUE))
    return Relation(df.select(*kept, VALUE), kept, dims, whole, out).normal()


def _with_fills(op: Op, col: Column, n: Column, fill, out: np.dtype) -> Column:
    """The fold of the stored cells with ``n`` more cells that hold the fill."""
    f = T.literal(fill, out)
    if op.name == "add":
        if T.is_complex(out):
            return F.struct((col["re"] + f["re"] * n).alias("re"), (col["im"] + f["im"] * n).alias("im"))
        return F.when(n > 0, col + (f * n)).otherwise(col).cast(T.storage(out))
    if op.name == "multiply" and T.is_integer(out) and out != T.uint64:  # modulo 2**64, as the stored cells
        squares = [int(fill)]
        while len(squares) < 63:
            squares.append(squares[-1] ** 2 % 2**64)
        squares = F.array(*[F.lit(int(np.uint64(x % 2**64).astype(np.int64))) for x in squares])
        few = F.pmod(n, F.lit(1 << 62)) if int(fill) % 2 else F.least(n, F.lit(64))  # odd powers come again, even ones are 0 from there on
        bits = F.transform(squares, lambda x, k: F.when(F.getbit(few.cast("bigint"), k.cast("int")) == 1, x).otherwise(F.lit(1).cast("bigint")))
        product = T.wrap(F.aggregate(bits, T.cast(col, out, T.int64), T.wrapped_product), out)
        return F.when(n > 0, product).otherwise(col)
    if op.name == "multiply":
        power = OPS["power"].build([f, n.cast("double")], [out, T.float64], out) if T.is_float(out) else OPS["power"].build([f, n.cast("bigint")], [out, T.int64], out)
        return F.when(n > 0, OPS["multiply"].build([col, power], [out, out], out)).otherwise(col)
    if op.name in ("logical_xor", "bitwise_xor"):
        return F.when(n % 2 == 1, op.build([col, f], [out, out], out)).otherwise(col)
    if op.name == "logaddexp":
        return F.when(n > 0, op.build([col, f + F.log(n.cast("double"))], [out, out], out)).otherwise(col)
    return F.when(n > 0, op.build([col, f], [out, out], out)).otherwise(col)


def _host_fold(op: Op, rel: Relation, kept: tuple[str, ...], drop: Sequence[str], out: np.dtype) -> DataFrame:
    keys = list(kept) or ["__all"]
    df = rel.df if kept else rel.df.withColumn("__all", F.lit(0).cast("bigint"))
    schema = ", ".join(f"{k} bigint" for k in keys) + f", {VALUE} {T.storage(out)}, __n bigint"
    order = list(drop)

    def fold(key, pdf):
        import pandas as pd

        values = pdf.sort_values(order)[VALUE].tolist()
        total = values[0]
        for x in values[1:]:
            total = op.value(total, x)
        return pd.DataFrame([[*key, np.asarray(total).astype(out)[()], len(values)]], columns=[*keys, VALUE, "__n"])

    return df.groupBy(*keys).applyInPandas(fold, schema)
