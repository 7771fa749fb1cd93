"""Registered queries over the benchmark tables, each with the SQL that gives the same rows.

Results are stored cells: one row for each cell that differs from the fill, with named coordinates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import coordframe as cf

from . import types as T
from .relation import VALUE
from .tensor import Tensor, from_relation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir)."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = " ".join(sql.split())
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extent(df: DataFrame, *columns: str) -> tuple[int, ...]:
    """One more than each key's maximum: the sizes of axes over them."""
    row = df.agg(*[F.max(c).alias(c) for c in columns]).first()
    return tuple((row[c] if row[c] is not None else -1) + 1 for c in columns)


def cells(x: Tensor, *names: str, value: str = "v", dense: bool = False) -> DataFrame:
    """A tensor's cells with named coordinates."""
    rel = x.rel.dense() if dense else x.rel.normal()
    return rel.df.select(*[F.col(f).alias(n) for f, n in zip(x.axes, names, strict=True)], F.col(VALUE).alias(value))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without the sign of zero."""
    return F.round(x, digits) + F.lit(0.0)


# tensors over the tables


def order_customer(spark, sf_dir) -> Tensor:
    orders = table(spark, sf_dir, "orders")
    return from_relation(orders, ["o_orderkey", "o_custkey"], None, extent(orders, "o_orderkey", "o_custkey"))


def customer_nation(spark, sf_dir) -> Tensor:
    customer = table(spark, sf_dir, "customer")
    return from_relation(customer, ["c_custkey", "c_nationkey"], None, (extent(customer, "c_custkey")[0], 25))


def order_part(spark, sf_dir) -> Tensor:
    """Units by order and part."""
    lines = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint"))
    orders, parts = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    return from_relation(lines, ["l_orderkey", "l_partkey"], "q", (extent(orders, "o_orderkey")[0], extent(parts, "p_partkey")[0]))


def part_supplier(spark, sf_dir) -> Tensor:
    """Units by part and supplier."""
    lines = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint"))
    parts, suppliers = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    return from_relation(lines, ["l_partkey", "l_suppkey"], "q", (extent(parts, "p_partkey")[0], extent(suppliers, "s_suppkey")[0]))


def part_brand(spark, sf_dir) -> Tensor:
    parts = table(spark, sf_dir, "part").withColumn("b", F.substring("p_brand", 7, 9).cast("int"))
    return from_relation(parts, ["p_partkey", "b"], None, (extent(parts, "p_partkey")[0], 100))


def part_units(spark, sf_dir, flag: str, fill: int = 0) -> Tensor:
    """Units by part of the lines with one return flag."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).withColumn("q", F.col("l_quantity").cast("bigint"))
    parts = table(spark, sf_dir, "part")
    return from_relation(lines, ["l_partkey"], "q", extent(parts, "p_partkey"), fill=fill)


def grid(spark, sf_dir) -> Tensor:
    """Customers by nation and key modulo 7: a 25 by 7 matrix."""
    customer = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey") % 7)
    return from_relation(customer, ["c_nationkey", "k"], None, (25, 7))


def embedding(spark, sf_dir) -> Tensor:
    e = table(spark, sf_dir, "embeddings")
    return cf.astype(cf.embedding_matrix(e, "vec_id", "embedding", extent(e, "vec_id")[0], 64), cf.float64)


def user_events(spark, sf_dir) -> Tensor:
    """Cents by user and rank of the event among the user's."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = events.withColumn("r", rank).withColumn("c", F.round(F.col("value") * 100).cast("bigint"))
    width = rows.agg(F.max("r")).first()[0]
    return from_relation(rows, ["user_id", "r"], "c", (extent(events, "user_id")[0], (width or 0) + 1), reduce=None)


_Q = "Q AS (SELECT l_partkey p, l_suppkey s, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) v FROM lineitem GROUP BY 1, 2)"
_M = "M AS (SELECT CAST(c_nationkey AS BIGINT) i, c_custkey % 7 j, COUNT(*) v FROM customer GROUP BY 1, 2)"
_E = "E AS (SELECT vec_id i, CAST(UNNEST(range(len(embedding))) AS BIGINT) j, CAST(UNNEST(embedding) AS DOUBLE) v FROM embeddings)"
_EV = "EV AS (SELECT user_id u, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 r, CAST(ROUND(value * 100) AS BIGINT) c FROM events)"
_AR = """A AS (SELECT l_partkey p, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
 R AS (SELECT l_partkey p, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)"""


# contractions


@query(
    "contract_nation_brand",
    """SELECT CAST(c_nationkey AS BIGINT) n, CAST(substr(p_brand, 7) AS BIGINT) b, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) v
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
def contract_nation_brand(spark, sf_dir):
    got = cf.einop(
        "R[n,b] += CN[c,n] * OC[o,c] * LP[o,p] * PB[p,b]",
        CN=customer_nation(spark, sf_dir),
        OC=order_customer(spark, sf_dir),
        LP=order_part(spark, sf_dir),
        PB=part_brand(spark, sf_dir),
    )
    return cells(got, "n", "b")


@query("matmul_part_supp", f"WITH {_Q} SELECT a.s s, b.s t, CAST(SUM(a.v * b.v) AS BIGINT) v FROM Q a JOIN Q b ON a.p = b.p GROUP BY 1, 2")
def matmul_part_supp(spark, sf_dir):
    q = part_supplier(spark, sf_dir)
    return cells(cf.matmul(q.T, q), "s", "t")


@query(
    "matvec_order_total",
    "SELECT l_orderkey o, CAST(SUM(CAST(l_quantity AS BIGINT) * CAST(ROUND(p_retailprice * 100) AS BIGINT)) AS BIGINT) v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def matvec_order_total(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("c", F.round(F.col("p_retailprice") * 100).cast("bigint"))
    price = from_relation(parts, ["p_partkey"], "c", extent(parts, "p_partkey"))
    return cells(cf.matmul(order_part(spark, sf_dir), price), "o")


@query(
    "tensordot_customer_line",
    """SELECT o_custkey c, CAST(l_linenumber AS BIGINT) l, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) v
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
def tensordot_customer_line(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint"))
    oc = order_customer(spark, sf_dir)
    ol = from_relation(lines, ["l_orderkey", "l_linenumber"], "q", (oc.shape[0], 8))
    return cells(cf.tensordot(oc, ol, axes=([0], [0])), "c", "l")


@query(
    "outer_customers_suppliers",
    """WITH c AS (SELECT c_nationkey n, COUNT(*) k FROM customer GROUP BY 1), s AS (SELECT s_nationkey n, COUNT(*) k FROM supplier GROUP BY 1)
    SELECT CAST(c.n AS BIGINT) a, CAST(s.n AS BIGINT) b, c.k * s.k v FROM c, s""",
)
def outer_customers_suppliers(spark, sf_dir):
    c = from_relation(table(spark, sf_dir, "customer"), ["c_nationkey"], None, (25,))
    s = from_relation(table(spark, sf_dir, "supplier"), ["s_nationkey"], None, (25,))
    return cells(cf.outer(c, s), "a", "b")


@query(
    "vecdot_neighbours",
    f"""WITH {_E} SELECT a.i i, ROUND(SUM(a.v * b.v), 6) + 0.0 v FROM E a JOIN E b ON a.j = b.j AND b.i = (a.i + (SELECT COUNT(*) FROM embeddings) - 1) % (SELECT COUNT(*) FROM embeddings)
    GROUP BY 1""",
)
def vecdot_neighbours(spark, sf_dir):
    e = embedding(spark, sf_dir)
    return cells(cf.vecdot(e, cf.roll(e, 1, axis=0)), "i", dense=True).withColumn("v", rounded(F.col("v")))


@query(
    "einsum_batch",
    """WITH E AS (SELECT vec_id % 8 b, (vec_id // 8) i, CAST(UNNEST(range(len(embedding))) AS BIGINT) j, CAST(ROUND(CAST(UNNEST(embedding) AS DOUBLE) * 100) AS BIGINT) v FROM embeddings)
    SELECT x.b b, x.i i, y.i k, CAST(SUM(x.v * y.v) AS BIGINT) v FROM E x JOIN E y ON x.b = y.b AND x.j = y.j GROUP BY 1, 2, 3 HAVING SUM(x.v * y.v) <> 0""",
)
def einsum_batch(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "x"))
    rows = e.select((F.col("vec_id") % 8).alias("b"), F.call_function("div", F.col("vec_id"), F.lit(8).cast("bigint")).alias("i"), "j", F.round(F.col("x").cast("double") * 100).cast("bigint").alias("x"))
    t = from_relation(rows, ["b", "i", "j"], "x", (8, extent(rows, "i")[0], 64))
    return cells(cf.einsum("bij,bkj->bik", t, t), "b", "i", "k")


_HOP = """G AS (SELECT CAST(c_nationkey AS BIGINT) i, CAST(s_nationkey AS BIGINT) j, MIN(CAST(ROUND(p_retailprice * 100) AS BIGINT)) v
 FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"""


def hops(spark, sf_dir) -> DataFrame:
    """The cheapest part that each nation's customers bought from each nation's suppliers."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("c", F.round(F.col("p_retailprice") * 100))


@query("semiring_minplus", f"WITH {_HOP} SELECT a.i i, b.j j, CAST(MIN(a.v + b.v) AS DOUBLE) v FROM G a JOIN G b ON a.j = b.i GROUP BY 1, 2")
def semiring_minplus(spark, sf_dir):
    g = from_relation(hops(spark, sf_dir), ["c_nationkey", "s_nationkey"], "c", (25, 25), fill=float("inf"), reduce="minimum")
    return cells(cf.einop("D[i,j] min= G[i,k] + H[k,j]", G=g, H=g), "i", "j")


@query("semiring_maxmin", f"WITH {_HOP} SELECT a.i i, b.j j, CAST(MAX(LEAST(a.v, b.v)) AS DOUBLE) v FROM G a JOIN G b ON a.j = b.i GROUP BY 1, 2")
def semiring_maxmin(spark, sf_dir):
    g = from_relation(hops(spark, sf_dir), ["c_nationkey", "s_nationkey"], "c", (25, 25), fill=float("-inf"), reduce="minimum")
    return cells(cf.einop("D[i,j] max= min(G[i,k], H[k,j])", G=g, H=g), "i", "j")


@query("semiring_reach", f"WITH {_HOP} SELECT DISTINCT a.i i, c.j j, true v FROM G a JOIN G b ON a.j = b.i JOIN G c ON b.j = c.i")
def semiring_reach(spark, sf_dir):
    g = cf.astype(from_relation(hops(spark, sf_dir), ["c_nationkey", "s_nationkey"], None, (25, 25)), cf.bool_)
    return cells(cf.einop("D[i,l] or= G[i,j] and H[j,k] and K[k,l]", G=g, H=g, K=g), "i", "l").withColumnRenamed("l", "j")


@query("matrix_power_paths", f"WITH {_HOP} SELECT a.i i, c.j j, COUNT(*) v FROM G a JOIN G b ON a.j = b.i JOIN G c ON b.j = c.i GROUP BY 1, 2")
def matrix_power_paths(spark, sf_dir):
    g = from_relation(hops(spark, sf_dir).select("c_nationkey", "s_nationkey").distinct(), ["c_nationkey", "s_nationkey"], None, (25, 25))
    return cells(cf.linalg.matrix_power(g, 3), "i", "j")


@query("trace_diagonal", f"WITH {_M} SELECT CAST(SUM(v) AS BIGINT) v FROM M WHERE i = j + 1")
def trace_diagonal(spark, sf_dir):
    return cells(cf.trace(grid(spark, sf_dir), offset=-1), dense=True)


# elementwise


@query("ew_add_outer", f"WITH {_AR} SELECT p_partkey p, COALESCE(A.v, 1) + COALESCE(R.v, 2) v FROM part LEFT JOIN A ON A.p = p_partkey LEFT JOIN R ON R.p = p_partkey WHERE COALESCE(A.v, 1) + COALESCE(R.v, 2) <> 3")
def ew_add_outer(spark, sf_dir):
    return cells(part_units(spark, sf_dir, "A", 1) + part_units(spark, sf_dir, "R", 2), "p")


@query("ew_mul_inner", f"WITH {_AR} SELECT A.p p, A.v * R.v v FROM A JOIN R ON A.p = R.p")
def ew_mul_inner(spark, sf_dir):
    return cells(part_units(spark, sf_dir, "A") * part_units(spark, sf_dir, "R"), "p")


@query("ew_divide", f"WITH {_AR} SELECT A.p p, ROUND(A.v / CAST(COALESCE(R.v, 0) + 1 AS DOUBLE), 6) v FROM A LEFT JOIN R ON A.p = R.p")
def ew_divide(spark, sf_dir):
    got = part_units(spark, sf_dir, "A") / (part_units(spark, sf_dir, "R") + 1)
    return cells(got, "p").withColumn("v", rounded(F.col("v")))


@query(
    "ew_logical",
    f"""WITH {_AR} SELECT p_partkey p, (A.v IS NOT NULL AND R.v IS NOT NULL) b, (A.v IS NOT NULL OR R.v IS NOT NULL) o, ((A.v IS NOT NULL) <> (R.v IS NOT NULL)) x
    FROM part LEFT JOIN A ON A.p = p_partkey LEFT JOIN R ON R.p = p_partkey""",
)
def ew_logical(spark, sf_dir):
    a, r = part_units(spark, sf_dir, "A"), part_units(spark, sf_dir, "R")
    parts = [cells(f(a, r), "p", value=n, dense=True) for n, f in (("b", cf.logical_and), ("o", cf.logical_or), ("x", cf.logical_xor))]
    return parts[0].join(parts[1], "p").join(parts[2], "p")


@query("ew_broadcast_rows", f"WITH {_M}, T AS (SELECT j, CAST(SUM(v) AS BIGINT) t FROM M GROUP BY 1) SELECT i, M.j j, v * t v FROM M JOIN T ON M.j = T.j")
def ew_broadcast_rows(spark, sf_dir):
    m = grid(spark, sf_dir)
    return cells(m * cf.sum(m, axis=0, keepdims=True), "i", "j")


def balances(spark, sf_dir) -> Tensor:
    customer = table(spark, sf_dir, "customer")
    return from_relation(customer, ["c_custkey"], "c_acctbal", extent(customer, "c_custkey"))


def columns(x: Tensor, made: dict[str, Tensor], key: str) -> DataFrame:
    """Vectors of one length side by side: a grid of their coordinates, to which each one's stored cells are joined on the same key."""
    n = next(iter(made.values())).size
    out = x.df.sparkSession.range(n).withColumnRenamed("id", key)
    for name, t in made.items():
        part = t.rel.normal().df.select(F.col(t.axes[0]).alias(key), F.col(VALUE).alias(name))
        out = out.join(part, key, "left").withColumn(name, F.coalesce(name, T.literal(t.fill_value, t.dtype)))
    return out


@query("where_clip", "SELECT c_custkey k, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0.0 END w, LEAST(GREATEST(c_acctbal, 100.0), 5000.0) c, LEAST(c_acctbal, 10.0) m FROM customer")
def where_clip(spark, sf_dir):
    b = balances(spark, sf_dir)
    return columns(b, {"w": cf.where(b > 0, b, 0.0), "c": cf.clip(b, 100.0, 5000.0), "m": cf.minimum(b, 10.0)}, "k")


@query(
    "math_rounding",
    """SELECT c_custkey k, FLOOR(c_acctbal) + 0.0 f, CEIL(c_acctbal) + 0.0 c, TRUNC(c_acctbal) + 0.0 t, round_even(c_acctbal, 0) + 0.0 r, CAST(SIGN(c_acctbal) AS DOUBLE) s, ABS(c_acctbal) a FROM customer""",
)
def math_rounding(spark, sf_dir):
    b = balances(spark, sf_dir)
    got = columns(b, {"f": cf.floor(b), "c": cf.ceil(b), "t": cf.trunc(b), "r": cf.round(b), "s": cf.sign(b), "a": cf.abs(b)}, "k")
    return got.select("k", *[(F.col(c) + 0.0).alias(c) for c in "fctrsa"])


@query(
    "math_functions",
    """SELECT c_custkey k, ROUND(SQRT(ABS(c_acctbal)), 6) q, ROUND(LN(1 + ABS(c_acctbal)), 6) l, ROUND(EXP(c_acctbal / 10000), 6) e, ROUND(SIN(c_acctbal), 6) + 0.0 s, ROUND(TANH(c_acctbal / 10000), 6) + 0.0 t,
    ROUND(ATAN2(c_acctbal, 100.0), 6) + 0.0 a FROM customer""",
)
def math_functions(spark, sf_dir):
    b = balances(spark, sf_dir)
    made = {"q": cf.sqrt(cf.abs(b)), "l": cf.log1p(cf.abs(b)), "e": cf.exp(b / 10000), "s": cf.sin(b), "t": cf.tanh(b / 10000), "a": cf.atan2(b, 100.0)}
    return columns(b, made, "k").select("k", *[rounded(F.col(c)).alias(c) for c in made])


def sizes(spark, sf_dir) -> Tensor:
    parts = table(spark, sf_dir, "part")
    return from_relation(parts, ["p_partkey"], "p_size", extent(parts, "p_partkey"), dtype="int64")


@query("cmp_logic", "SELECT p_partkey k, p_size > 25 g, p_size <= 10 l, p_size = 7 e, (p_size > 10 AND p_size < 40) b, NOT (p_size > 10) n FROM part")
def cmp_logic(spark, sf_dir):
    s = sizes(spark, sf_dir)
    return columns(s, {"g": s > 25, "l": s <= 10, "e": cf.equal(s, 7), "b": cf.logical_and(s > 10, s < 40), "n": cf.logical_not(s > 10)}, "k")


@query("bit_operations", "SELECT p_partkey k, CAST(p_size & 12 AS BIGINT) a, CAST(p_size | 3 AS BIGINT) o, CAST(xor(p_size, 21) AS BIGINT) x, CAST(p_size * 8 AS BIGINT) l, CAST(p_size // 4 AS BIGINT) r, CAST(-p_size - 1 AS BIGINT) i FROM part")
def bit_operations(spark, sf_dir):
    s = sizes(spark, sf_dir)
    return columns(s, {"a": s & 12, "o": s | 3, "x": s ^ 21, "l": s << 3, "r": s >> 2, "i": ~s}, "k")


@query("int_division", "SELECT p_partkey k, CAST(FLOOR((p_size - 25) / 7.0) AS BIGINT) d, CAST((p_size - 25) - 7 * FLOOR((p_size - 25) / 7.0) AS BIGINT) m, CAST((p_size - 25) * (p_size - 25) * (p_size - 25) AS BIGINT) p FROM part")
def int_division(spark, sf_dir):
    s = sizes(spark, sf_dir) - 25
    return columns(s, {"d": s // 7, "m": s % 7, "p": s**3}, "k")


# reductions, scans, order


@query("reduce_moments", f"WITH {_E} SELECT i k, ROUND(SUM(v), 6) + 0.0 s, ROUND(AVG(v), 6) + 0.0 m, ROUND(VAR_POP(v), 6) v, ROUND(STDDEV_SAMP(v), 6) d, MIN(v) lo, MAX(v) hi FROM E GROUP BY 1")
def reduce_moments(spark, sf_dir):
    e = embedding(spark, sf_dir)
    made = {"s": cf.sum(e, axis=1), "m": cf.mean(e, axis=1), "v": cf.var(e, axis=1), "d": cf.std(e, axis=1, correction=1), "lo": cf.min(e, axis=1), "hi": cf.max(e, axis=1)}
    return columns(e, made, "k").select("k", *[rounded(F.col(c)).alias(c) for c in "smvd"], "lo", "hi")


@query("reduce_columns", f"WITH {_E} SELECT j k, ROUND(SUM(v), 4) + 0.0 s, MIN(v) lo FROM E GROUP BY 1")
def reduce_columns(spark, sf_dir):
    e = embedding(spark, sf_dir)
    return columns(e, {"s": cf.sum(e, axis=0), "lo": cf.min(e, axis=0)}, "k").withColumn("s", rounded(F.col("s"), 4))


@query("reduce_filled", f"WITH {_AR} SELECT CAST((SELECT SUM(v) FROM A) + (SELECT COUNT(*) FROM part) - (SELECT COUNT(*) FROM A) AS BIGINT) v")
def reduce_filled(spark, sf_dir):
    return cells(cf.sum(part_units(spark, sf_dir, "A", 1)), dense=True)


@query("reduce_prod", "SELECT CAST(s_nationkey AS BIGINT) k, CAST(PRODUCT(s_suppkey % 2 + 1) AS BIGINT) v FROM supplier GROUP BY 1 HAVING PRODUCT(s_suppkey % 2 + 1) <> 1")
def reduce_prod(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").withColumn("x", F.col("s_suppkey") % 2 + 1)
    t = from_relation(suppliers, ["s_nationkey", "s_suppkey"], "x", (25, extent(suppliers, "s_suppkey")[0]), fill=1)
    return cells(cf.prod(t, axis=1), "k")


@query("reduce_any_all", f"WITH {_M} SELECT i k, COUNT(*) FILTER (v > 2) > 0 a, COUNT(*) = 7 e FROM M GROUP BY 1")
def reduce_any_all(spark, sf_dir):
    m = grid(spark, sf_dir)
    got = columns(m, {"a": cf.any(m > 2, axis=1), "e": cf.all(m, axis=1), "n": cf.any(m, axis=1)}, "k")
    return got.where("n").drop("n")


@query("count_nonzero", "SELECT l_orderkey o, COUNT(DISTINCT l_linenumber) v FROM lineitem GROUP BY 1")
def count_nonzero(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    t = from_relation(lines, ["l_orderkey", "l_linenumber"], "l_quantity", (extent(lines, "l_orderkey")[0], 8))
    return cells(cf.count_nonzero(t, axis=1), "o")


@query("count_nonfill", "SELECT COUNT(*) FILTER (q <> 5) v FROM (SELECT l_orderkey, l_partkey, SUM(l_quantity) q FROM lineitem GROUP BY 1, 2)")
def count_nonfill(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    t = from_relation(lines, ["l_orderkey", "l_partkey"], "l_quantity", extent(lines, "l_orderkey", "l_partkey"), fill=5.0)
    return cells(cf.count_nonfill(t), dense=True)


@query("argmin_argmax", f"WITH {_E} SELECT i k, arg_min(j, v) lo, arg_max(j, v) hi FROM (SELECT * FROM E ORDER BY i, j) GROUP BY 1")
def argmin_argmax(spark, sf_dir):
    e = embedding(spark, sf_dir)
    return columns(e, {"lo": cf.argmin(e, axis=1), "hi": cf.argmax(e, axis=1)}, "k")


@query("cumulative_sum", f"WITH {_EV}, W AS (SELECT MAX(r) m FROM EV), G AS (SELECT u, UNNEST(range(m + 1)) r FROM (SELECT DISTINCT u FROM EV), W) SELECT * FROM (SELECT G.u u, G.r r, CAST(SUM(COALESCE(c, 0)) OVER (PARTITION BY G.u ORDER BY G.r) AS BIGINT) v FROM G LEFT JOIN EV ON G.u = EV.u AND G.r = EV.r) WHERE v <> 0")
def cumulative_sum(spark, sf_dir):
    return cells(cf.cumulative_sum(user_events(spark, sf_dir), axis=1), "u", "r")


@query("cumulative_max", f"WITH {_EV}, W AS (SELECT MAX(r) m FROM EV), G AS (SELECT u, UNNEST(range(m + 1)) r FROM (SELECT DISTINCT u FROM EV), W) SELECT * FROM (SELECT G.u u, G.r r, MAX(COALESCE(c, 0)) OVER (PARTITION BY G.u ORDER BY G.r) v FROM G LEFT JOIN EV ON G.u = EV.u AND G.r = EV.r) WHERE v <> 0")
def cumulative_max(spark, sf_dir):
    return cells(cf.cumulative("maximum", user_events(spark, sf_dir), axis=1), "u", "r")


@query("cumulative_prod", f"WITH {_M}, G AS (SELECT CAST(i AS BIGINT) i, CAST(j AS BIGINT) j FROM range(25) a(i), range(7) b(j)) SELECT i, j, CAST(v AS BIGINT) v FROM (SELECT G.i i, G.j j, PRODUCT(COALESCE(v, 0) % 3 + 1) OVER (PARTITION BY G.i ORDER BY G.j) v FROM G LEFT JOIN M ON G.i = M.i AND G.j = M.j)")
def cumulative_prod(spark, sf_dir):
    return cells(cf.cumulative_prod(grid(spark, sf_dir) % 3 + 1, axis=1), "i", "j", dense=True)


@query("diff_events", f"WITH {_EV}, W AS (SELECT MAX(r) m FROM EV), G AS (SELECT u, UNNEST(range(m)) r FROM (SELECT DISTINCT u FROM EV), W) SELECT * FROM (SELECT G.u u, G.r r, COALESCE(b.c, 0) - COALESCE(a.c, 0) v FROM G LEFT JOIN EV a ON G.u = a.u AND G.r = a.r LEFT JOIN EV b ON G.u = b.u AND G.r + 1 = b.r) WHERE v <> 0")
def diff_events(spark, sf_dir):
    return cells(cf.diff(user_events(spark, sf_dir), axis=1), "u", "r")


@query("sort_rows", f"WITH {_E} SELECT i, ROW_NUMBER() OVER (PARTITION BY i ORDER BY v, j) - 1 r, v FROM E")
def sort_rows(spark, sf_dir):
    return cells(cf.sort(embedding(spark, sf_dir), axis=1), "i", "r", dense=True)


@query("argsort_rows", f"WITH {_E} SELECT i, ROW_NUMBER() OVER (PARTITION BY i ORDER BY v DESC, j) - 1 r, j v FROM E")
def argsort_rows(spark, sf_dir):
    return cells(cf.argsort(embedding(spark, sf_dir), axis=1, descending=True), "i", "r", dense=True)


@query("topk", f"WITH {_E} SELECT * FROM (SELECT i, ROW_NUMBER() OVER (PARTITION BY i ORDER BY v DESC, j) - 1 r, v FROM E) WHERE r < 5")
def topk(spark, sf_dir):
    e = cf.sort(embedding(spark, sf_dir), axis=1, descending=True)
    return cells(cf.take(e, cf.arange(5), axis=1), "i", "r", dense=True)


@query("searchsorted_prices", "SELECT p_partkey k, CAST((p_retailprice > 950) AS BIGINT) + 2 * CAST((p_retailprice > 1000) AS BIGINT) + CAST((p_retailprice > 1200) AS BIGINT) + CAST((p_retailprice > 1500) AS BIGINT) v FROM part")
def searchsorted_prices(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    prices = from_relation(parts, ["p_partkey"], "p_retailprice", extent(parts, "p_partkey"))
    return cells(cf.searchsorted(cf.asarray([950.0, 1000.0, 1000.0, 1200.0, 1500.0]), prices), "k", dense=True)


# shape and selection: name -> (function of the grid, names, SQL over M(i, j, v))

_SHAPES: dict[str, tuple[Callable[[Tensor], Tensor], str, str]] = {
    "shape_permute": (lambda m: cf.permute_dims(m, (1, 0)), "i j", "SELECT j i, i j, v FROM M"),
    "shape_reshape": (lambda m: cf.reshape(m, (7, -1)), "i j", "SELECT (i * 7 + j) // 25 i, (i * 7 + j) % 25 j, v FROM M"),
    "shape_expand_squeeze": (lambda m: cf.squeeze(cf.expand_dims(m, (0, 2)), 0), "i z j", "SELECT i, CAST(0 AS BIGINT) z, j, v FROM M"),
    "shape_flip": (lambda m: cf.flip(m, axis=0), "i j", "SELECT 24 - i i, j, v FROM M"),
    "shape_roll": (lambda m: cf.roll(m, 3, axis=1), "i j", "SELECT i, (j + 3) % 7 j, v FROM M"),
    "shape_roll_flat": (lambda m: cf.roll(m, 10), "i j", "SELECT ((i * 7 + j + 10) % 175) // 7 i, (i * 7 + j + 10) % 7 j, v FROM M"),
    "shape_concat": (lambda m: cf.concat([m, m + 1], axis=0), "i j", "SELECT i, j, v FROM M UNION ALL SELECT CAST(a.i + 25 AS BIGINT), CAST(b.j AS BIGINT), COALESCE(v, 0) + 1 FROM range(25) a(i) CROSS JOIN range(7) b(j) LEFT JOIN M ON M.i = a.i AND M.j = b.j"),
    "shape_stack": (lambda m: cf.stack([m, m * 2], axis=1), "i s j", "SELECT i, CAST(0 AS BIGINT) s, j, v FROM M UNION ALL SELECT i, 1, j, 2 * v FROM M"),
    "shape_unstack": (lambda m: cf.unstack(m, axis=1)[3], "i", "SELECT i, v FROM M WHERE j = 3"),
    "shape_tile": (lambda m: cf.tile(m, (1, 2)), "i j", "SELECT i, j + 7 * r j, v FROM M CROSS JOIN range(2) t(r)"),
    "shape_repeat": (lambda m: cf.repeat(m, 3, axis=1), "i j", "SELECT i, 3 * j + r j, v FROM M CROSS JOIN range(3) t(r)"),
    "shape_take": (lambda m: cf.take(m, cf.asarray([5, 0, -1]), axis=1), "i j", "SELECT i, CAST(n AS BIGINT) j, v FROM M JOIN (VALUES (0, 5), (1, 0), (2, 6)) t(n, s) ON j = s"),
    "shape_take_along_axis": (lambda m: cf.take_along_axis(m, cf.argsort(m, axis=1), axis=1), "i j", "SELECT * FROM (SELECT CAST(a.i AS BIGINT) i, ROW_NUMBER() OVER (PARTITION BY a.i ORDER BY COALESCE(v, 0), b.j) - 1 j, COALESCE(v, 0) v FROM range(25) a(i) CROSS JOIN range(7) b(j) LEFT JOIN M ON M.i = a.i AND M.j = b.j) WHERE v <> 0"),
    "shape_triu": (lambda m: cf.triu(m, k=1), "i j", "SELECT * FROM M WHERE j - i >= 1"),
    "shape_tril": (lambda m: cf.tril(m), "i j", "SELECT * FROM M WHERE j - i <= 0"),
    "shape_diagonal": (lambda m: cf.diagonal(m, offset=-2), "i", "SELECT j i, v FROM M WHERE i = j + 2"),
    "shape_diag": (lambda m: cf.diag(cf.sum(m, axis=1)), "i j", "SELECT i, i j, CAST(SUM(v) AS BIGINT) v FROM M GROUP BY 1"),
    "shape_slice": (lambda m: m[2:20:3, ::-1], "i j", "SELECT (i - 2) // 3 i, 6 - j j, v FROM M WHERE i >= 2 AND i < 20 AND (i - 2) % 3 = 0"),
    "shape_broadcast_to": (lambda m: cf.broadcast_to(m[0], (4, 7)), "i j", "SELECT CAST(r AS BIGINT) i, j, v FROM M CROSS JOIN range(4) t(r) WHERE i = 0"),
    "shape_moveaxis": (lambda m: cf.moveaxis(cf.reshape(m, (5, 5, 7)), 0, -1), "a b c", "SELECT i % 5 a, j b, i // 5 c, v FROM M"),
    "shape_diff": (lambda m: cf.diff(m, axis=0), "i j", "SELECT * FROM (SELECT CAST(a.i AS BIGINT) i, CAST(b.j AS BIGINT) j, COALESCE(y.v, 0) - COALESCE(x.v, 0) v FROM range(24) a(i) CROSS JOIN range(7) b(j) LEFT JOIN M x ON x.i = a.i AND x.j = b.j LEFT JOIN M y ON y.i = a.i + 1 AND y.j = b.j) WHERE v <> 0"),
    "shape_astype": (lambda m: cf.astype(m * 100, cf.int8), "i j", "SELECT * FROM (SELECT i, j, CAST((v * 100 + 128) % 256 - 128 AS TINYINT) v FROM M) WHERE v <> 0"),
    "shape_meshgrid": (lambda m: cf.add(*cf.meshgrid(cf.sum(m, axis=0), cf.sum(m, axis=1))), "i j", "SELECT CAST(a.i AS BIGINT) i, CAST(b.j AS BIGINT) j, CAST((SELECT SUM(v) FROM M WHERE M.j = b.j) + COALESCE((SELECT SUM(v) FROM M WHERE M.i = a.i), 0) AS BIGINT) v FROM range(25) a(i) CROSS JOIN range(7) b(j)"),
}
for _name, (_function, _names, _sql) in _SHAPES.items():

    def _run(spark, sf_dir, function=_function, names=_names):
        return cells(function(grid(spark, sf_dir)), *names.split())

    query(_name, f"WITH {_M} {_sql}")(_run)


@query("create_patterns", "SELECT CAST(i AS BIGINT) i, CAST(i + 2 AS BIGINT) j, CAST(3 * i + 5 AS BIGINT) v FROM range(98) t(i)")
def create_patterns(spark, sf_dir):
    return cells(cf.eye(100, k=2, dtype=cf.int64) * cf.expand_dims(cf.arange(5, 305, 3), 1), "i", "j")


@query("create_linspace", "SELECT CAST(i AS BIGINT) i, ROUND(i / 16.0, 6) v FROM range(17) t(i)")
def create_linspace(spark, sf_dir):
    return cells(cf.linspace(0.0, 1.0, 17), "i", dense=True).withColumn("v", rounded(F.col("v")))


@query("norms", f"WITH {_E} SELECT i k, COUNT(*) FILTER (v <> 0) + 0.0 z, ROUND(SUM(ABS(v)), 6) o, ROUND(SQRT(SUM(v * v)), 6) t, MAX(ABS(v)) m FROM E GROUP BY 1")
def norms(spark, sf_dir):
    e = embedding(spark, sf_dir)
    norm = cf.linalg.vector_norm
    made = {"z": norm(e, axis=1, ord=0), "o": norm(e, axis=1, ord=1), "t": norm(e, axis=1), "m": norm(e, axis=1, ord=float("inf"))}
    return columns(e, made, "k").withColumn("o", rounded(F.col("o"))).withColumn("t", rounded(F.col("t")))


@query("matrix_norms", f"WITH {_M} SELECT ROUND((SELECT SQRT(SUM(v * v)) FROM M), 6) f, (SELECT MAX(s) + 0.0 FROM (SELECT SUM(v) s FROM M GROUP BY j)) o, (SELECT MAX(s) + 0.0 FROM (SELECT SUM(v) s FROM M GROUP BY i)) r")
def matrix_norms(spark, sf_dir):
    m = grid(spark, sf_dir)
    parts = [cells(cf.linalg.matrix_norm(m, ord=o), value=n, dense=True) for n, o in (("f", "fro"), ("o", 1), ("r", float("inf")))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2]).select(*[rounded(F.col(c).cast("double")).alias(c) for c in "for"])


@query("cross_product", "SELECT vec_id i, CAST(0 AS BIGINT) j, ROUND(CAST(embedding[2] AS DOUBLE) * embedding[6] - CAST(embedding[3] AS DOUBLE) * embedding[5], 6) + 0.0 v FROM embeddings UNION ALL SELECT vec_id, 1, ROUND(CAST(embedding[3] AS DOUBLE) * embedding[4] - CAST(embedding[1] AS DOUBLE) * embedding[6], 6) + 0.0 FROM embeddings UNION ALL SELECT vec_id, 2, ROUND(CAST(embedding[1] AS DOUBLE) * embedding[5] - CAST(embedding[2] AS DOUBLE) * embedding[4], 6) + 0.0 FROM embeddings")
def cross_product(spark, sf_dir):
    e = embedding(spark, sf_dir)
    return cells(cf.linalg.cross(e[:, :3], e[:, 3:6]), "i", "j", dense=True).withColumn("v", rounded(F.col("v")))


@query("logical_plan", f"WITH {_Q} SELECT p, CAST(SUM(v) AS BIGINT) v FROM Q GROUP BY 1")
def logical_plan(spark, sf_dir):
    from .plans.ir import Aggregate, MapJoin, Plan, Produces, Query, Relabel, Table

    q = part_supplier(spark, sf_dir)
    ones = cf.astype(cf.ones((q.shape[1],)), cf.int64)
    plan = Plan((Query("T", Aggregate(cf.ffuncs.get("add"), 0, MapJoin(cf.ffuncs.get("multiply"), (Table(q, ("p", "s")), Table(ones, ("s",)))), ("s",))), Query("U", Relabel(Table(cf.lazy(q), ("a", "b")), ("x", "y"))), Produces(("T",))))
    return cells(plan.run()[0], "p")


@query("size_statistics", f"WITH {_Q} SELECT COUNT(*) nnz, COUNT(DISTINCT p) parts, COUNT(DISTINCT s) suppliers, (SELECT MAX(k) FROM (SELECT COUNT(*) k FROM Q GROUP BY s)) degree FROM Q")
def size_statistics(spark, sf_dir):
    s = cf.DCStats.of(part_supplier(spark, sf_dir))
    return spark.createDataFrame([(int(s.nnz), s.distinct["i0"], s.distinct["i1"], s.degree["i1"])], "nnz long, parts long, suppliers long, degree long")


# factorisations and transforms: SQL gives the products that they must multiply back to


def gram(spark, sf_dir) -> Tensor:
    """The 64 by 64 matrix of products of embedding columns plus the identity, well conditioned."""
    e = embedding(spark, sf_dir)
    return cf.matmul(e.T, e) + cf.eye(64)


_G = f"{_E}, G AS (SELECT a.j i, b.j j, SUM(a.v * b.v) + CASE WHEN a.j = b.j THEN 1 ELSE 0 END v FROM E a JOIN E b ON a.i = b.i GROUP BY a.j, b.j)"
#: The determinant of the leading 3 by 3 block.
_DET = """D AS (SELECT MAX(v) FILTER (i = 0 AND j = 0) a, MAX(v) FILTER (i = 0 AND j = 1) b, MAX(v) FILTER (i = 0 AND j = 2) c, MAX(v) FILTER (i = 1 AND j = 1) d,
 MAX(v) FILTER (i = 1 AND j = 2) e, MAX(v) FILTER (i = 2 AND j = 2) f FROM G), DET AS (SELECT a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) x FROM D)"""


def side_by_side(made: dict[str, Tensor], digits: int = 5) -> DataFrame:
    """Matrices as columns over their coordinates, each cell rounded."""
    out = None
    for name, t in made.items():
        part = cells(t, "i", "j", value=name, dense=True)
        out = part if out is None else out.join(part, ["i", "j"])
    return out.select("i", "j", *[rounded(F.col(c), digits).alias(c) for c in made])


@query("linalg_inverse", "SELECT CAST(i AS BIGINT) i, CAST(j AS BIGINT) j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END a, CASE WHEN i = j THEN 1.0 ELSE 0.0 END p FROM range(64) x(i), range(64) y(j)")
def linalg_inverse(spark, sf_dir):
    g = gram(spark, sf_dir)
    return side_by_side({"a": g @ cf.linalg.inv(g), "p": cf.linalg.pinv(g) @ g}, 6)


@query("linalg_solve", "SELECT CAST(i AS BIGINT) i, i + 1.0 v FROM range(64) x(i)")
def linalg_solve(spark, sf_dir):
    g = gram(spark, sf_dir)
    return cells(g @ cf.linalg.solve(g, cf.arange(1.0, 65.0)), "i", dense=True).withColumn("v", rounded(F.col("v")))


@query("linalg_factors", f"WITH {_G} SELECT i, j, ROUND(v, 5) + 0.0 l, ROUND(v, 5) + 0.0 q, ROUND(v, 5) + 0.0 p, ROUND(v, 5) + 0.0 e, ROUND(v, 5) + 0.0 s FROM G")
def linalg_factors(spark, sf_dir):
    g = gram(spark, sf_dir)
    low, qr, eig, svd = cf.linalg.cholesky(g), cf.linalg.qr(g), cf.linalg.eigh(g), cf.linalg.svd(g)
    p, lo, up = cf.linalg.lu(g)
    return side_by_side(
        {
            "l": low @ low.T,
            "q": qr.Q @ qr.R,
            "p": p @ lo @ up,
            "e": (eig.eigenvectors * cf.expand_dims(eig.eigenvalues, 0)) @ eig.eigenvectors.T,
            "s": (svd.U * cf.expand_dims(svd.S, 0)) @ svd.Vh,
        }
    )


@query(
    "linalg_spectra",
    f"WITH {_G}, {_DET} SELECT ROUND((SELECT SUM(v) FROM G WHERE i = j), 5) trace, ROUND((SELECT SUM(v * v) FROM G), 4) squares, CAST(64 AS BIGINT) AS \"rank\", ROUND((SELECT x FROM DET), 5) det, ROUND((SELECT LN(x) FROM DET), 5) logdet, ROUND((SELECT SUM(v) FROM G WHERE i = j), 5) nuclear",
)
def linalg_spectra(spark, sf_dir):
    g = gram(spark, sf_dir)
    corner, values = g[:3, :3], cf.linalg.svdvals(g)
    made = {
        "trace": cf.sum(cf.linalg.eigvalsh(g)),
        "squares": cf.sum(values * values),
        "rank": cf.linalg.matrix_rank(g),
        "det": cf.linalg.det(corner),
        "logdet": cf.linalg.slogdet(corner).logabsdet,
        "nuclear": cf.linalg.matrix_norm(g, ord="nuc"),
    }
    out = None
    for name, t in made.items():
        part = cells(t, value=name, dense=True)
        out = part if out is None else out.crossJoin(part)
    return out.select(*[F.col(c) if c == "rank" else rounded(F.col(c), 4 if c == "squares" else 5).alias(c) for c in made])


_WAVE = "FROM E, range(64) t(k) GROUP BY i, k"


@query("fft_rows", f"WITH {_E} SELECT i, CAST(k AS BIGINT) k, ROUND(SUM(v * COS(2 * PI() * j * k / 64)), 5) + 0.0 re, ROUND(SUM(-v * SIN(2 * PI() * j * k / 64)), 5) + 0.0 im {_WAVE}")
def fft_rows(spark, sf_dir):
    f = cf.fft.fft(embedding(spark, sf_dir), axis=1)
    made = cells(cf.real(f), "i", "k", value="re", dense=True).join(cells(cf.imag(f), "i", "k", value="im", dense=True), ["i", "k"])
    return made.select("i", "k", rounded(F.col("re"), 5).alias("re"), rounded(F.col("im"), 5).alias("im"))


@query("fft_power", f"WITH {_E} SELECT i, CAST(k AS BIGINT) k, ROUND(POW(SUM(v * COS(2 * PI() * j * k / 64)), 2) + POW(SUM(v * SIN(2 * PI() * j * k / 64)), 2), 5) + 0.0 v {_WAVE} HAVING k <= 32")
def fft_power(spark, sf_dir):
    """The power spectrum of real rows."""
    f = cf.fft.rfft(embedding(spark, sf_dir), axis=1)
    return cells(cf.square(cf.abs(f)), "i", "k", dense=True).withColumn("v", rounded(F.col("v"), 5))


@query("fft_round_trip", f"WITH {_E} SELECT i, j, ROUND(v, 6) + 0.0 a, ROUND(v, 6) + 0.0 b, ROUND(v, 6) + 0.0 c, ROUND(v, 6) + 0.0 d, ROUND(v, 6) + 0.0 e FROM E")
def fft_round_trip(spark, sf_dir):
    e, fft = embedding(spark, sf_dir), cf.fft
    made = {"a": fft.irfft(fft.rfft(e)), "b": cf.real(fft.ifftn(fft.fftn(e))), "c": fft.hfft(fft.ihfft(e)), "d": fft.irfftn(fft.rfftn(e)), "e": cf.real(fft.ifft(fft.fft(e, axis=0), axis=0))}
    return side_by_side(made, 6)


@query("fft_frequencies", "SELECT CAST(i AS BIGINT) i, ROUND(CASE WHEN i < 5 THEN i ELSE i - 9 END / 4.5, 6) f, ROUND((i - 4) / 4.5, 6) s, ROUND(CASE WHEN i < 5 THEN i ELSE i - 9 END / 4.5, 6) b FROM range(9) t(i)")
def fft_frequencies(spark, sf_dir):
    f = cf.fft.fftfreq(9, d=0.5)
    made = columns(f, {"f": f, "s": cf.fft.fftshift(f), "b": cf.fft.ifftshift(cf.fft.fftshift(f))}, "i")
    return made.select("i", *[rounded(F.col(c)).alias(c) for c in "fsb"])


@query("fft_real_frequencies", "SELECT CAST(i AS BIGINT) i, ROUND(i / 10.0, 6) v FROM range(6) t(i)")
def fft_real_frequencies(spark, sf_dir):
    return cells(cf.fft.rfftfreq(10), "i", dense=True).withColumn("v", rounded(F.col("v")))


@query(
    "special_functions",
    """SELECT c_custkey k, nextafter(c_acctbal, 1e9) n, ROUND(LN(EXP(c_acctbal / 1000) + EXP(1.0)), 6) g, -ABS(c_acctbal) c, c_acctbal < 0 z, ROUND(SQRT(c_acctbal * c_acctbal + 9), 6) h FROM customer""",
)
def special_functions(spark, sf_dir):
    b = balances(spark, sf_dir)
    got = columns(b, {"n": cf.nextafter(b, 1e9), "g": cf.logaddexp(b / 1000, 1.0), "c": cf.copysign(b, -1.0), "z": cf.signbit(b), "h": cf.hypot(b, 3.0)}, "k")
    return got.withColumn("g", rounded(F.col("g"))).withColumn("h", rounded(F.col("h")))


_X = "c_acctbal / 10000"


@query(
    "math_logarithms",
    "SELECT c_custkey k, ROUND(LN(ABS(c_acctbal) + 1), 6) a, ROUND(LOG2(ABS(c_acctbal) + 1), 6) b, ROUND(LOG10(ABS(c_acctbal) + 1), 6) c, ROUND(EXP(c_acctbal / 10000) - 1, 6) + 0.0 d, ROUND(SQRT(ABS(c_acctbal) + 1), 6) e FROM customer",
)
def math_logarithms(spark, sf_dir):
    b = balances(spark, sf_dir)
    x = cf.abs(b) + 1.0
    made = {"a": cf.log(x), "b": cf.log2(x), "c": cf.log10(x), "d": cf.expm1(b / 10000), "e": cf.sqrt(x)}
    return columns(b, made, "k").select("k", *[rounded(F.col(c)).alias(c) for c in made])


@query(
    "math_trigonometry",
    f"SELECT c_custkey k, ROUND(COS(c_acctbal), 6) + 0.0 a, ROUND(TAN({_X}), 6) + 0.0 b, ROUND(ASIN({_X}), 6) + 0.0 c, ROUND(ACOS({_X}), 6) + 0.0 d, ROUND(ATAN(c_acctbal), 6) + 0.0 e FROM customer",
)
def math_trigonometry(spark, sf_dir):
    b = balances(spark, sf_dir)
    x = b / 10000
    made = {"a": cf.cos(b), "b": cf.tan(x), "c": cf.asin(x), "d": cf.acos(x), "e": cf.atan(b)}
    return columns(b, made, "k").select("k", *[rounded(F.col(c)).alias(c) for c in made])


@query(
    "math_hyperbolic",
    f"SELECT c_custkey k, ROUND((EXP({_X}) - EXP(-({_X}))) / 2, 6) + 0.0 a, ROUND((EXP({_X}) + EXP(-({_X}))) / 2, 6) + 0.0 b, ROUND(LN({_X} + SQRT({_X} * {_X} + 1)), 6) + 0.0 c, ROUND(LN(ABS({_X}) + 1 + SQRT((ABS({_X}) + 1) * (ABS({_X}) + 1) - 1)), 6) + 0.0 d, ROUND(LN((1 + {_X}) / (1 - {_X})) / 2, 6) + 0.0 e FROM customer",
)
def math_hyperbolic(spark, sf_dir):
    b = balances(spark, sf_dir)
    x = b / 10000
    made = {"a": cf.sinh(x), "b": cf.cosh(x), "c": cf.asinh(x), "d": cf.acosh(cf.abs(x) + 1.0), "e": cf.atanh(x)}
    return columns(b, made, "k").select("k", *[rounded(F.col(c)).alias(c) for c in made])


@query("math_signs", "SELECT c_custkey k, ROUND(1 / (ABS(c_acctbal) + 1), 6) r, -c_acctbal n, c_acctbal p, ROUND(c_acctbal * c_acctbal, 4) s FROM customer")
def math_signs(spark, sf_dir):
    b = balances(spark, sf_dir)
    got = columns(b, {"r": cf.reciprocal(cf.abs(b) + 1.0), "n": cf.negative(b), "p": cf.positive(b), "s": cf.square(b)}, "k")
    return got.select("k", rounded(F.col("r")).alias("r"), (F.col("n") + 0.0).alias("n"), "p", rounded(F.col("s"), 4).alias("s"))


@query("math_remainders", "SELECT p_partkey k, CAST((p_size - 25) - 7 * FLOOR((p_size - 25) / 7.0) AS BIGINT) m, CAST(FLOOR((p_size - 25) / 7.0) AS BIGINT) q, CAST(p_size AS BIGINT) c FROM part")
def math_remainders(spark, sf_dir):
    s = sizes(spark, sf_dir)
    quotient, rest = divmod(s - 25, 7)
    return columns(s, {"m": rest, "q": quotient, "c": quotient * 7 + rest + 25}, "k")


@query("cmp_more", "SELECT p_partkey k, p_size <> 7 n, p_size >= 25 g, p_size < 10 l, p_size <> 7 d, p_size = 7 s FROM part")
def cmp_more(spark, sf_dir):
    s = sizes(spark, sf_dir)
    made = {"n": cf.not_equal(s, 7), "g": cf.greater_equal(s, 25), "l": cf.less(s, 10), "d": cf.not_same(s, 7), "s": cf.same(s, 7)}
    return columns(s, made, "k")


@query("cmp_classes", "SELECT c_custkey k, c_acctbal > 5000 n, c_acctbal < 0 i, NOT (c_acctbal > 5000 OR c_acctbal < 0) f FROM customer")
def cmp_classes(spark, sf_dir):
    """NaN, infinite and finite cells."""
    b = balances(spark, sf_dir)
    x = cf.where(b > 5000, float("nan"), cf.where(b < 0, float("inf"), b))
    return columns(x, {"n": cf.isnan(x), "i": cf.isinf(x), "f": cf.isfinite(x)}, "k")


_ZC = f"{_E}, C AS (SELECT i, j, v re, 2 * v - 1 im FROM E WHERE j < 8)"


@query(
    "complex_functions",
    f"""WITH {_ZC} SELECT i, j, ROUND(EXP(re) * COS(im), 5) + 0.0 a, ROUND(EXP(re) * SIN(im), 5) + 0.0 b, ROUND(LN(SQRT(re * re + im * im)), 5) + 0.0 c, ROUND(SIN(re) * (EXP(im) + EXP(-im)) / 2, 5) + 0.0 d,
    ROUND(SQRT((SQRT(re * re + im * im) + re) / 2), 5) + 0.0 e, ROUND(re * re - im * im, 5) + 0.0 f, ROUND(-im, 5) + 0.0 g, ROUND(SQRT(re * re + im * im), 5) h FROM C""",
)
def complex_functions(spark, sf_dir):
    e = embedding(spark, sf_dir)[:, :8]
    z = e + (e * 2 - 1) * 1j
    made = {"a": cf.real(cf.exp(z)), "b": cf.imag(cf.exp(z)), "c": cf.real(cf.log(z)), "d": cf.real(cf.sin(z)), "e": cf.real(cf.sqrt(z)), "f": cf.real(z**2.0), "g": cf.imag(cf.conj(z)), "h": cf.abs(z)}
    return side_by_side(made, 5)


@query("create_constants", "SELECT CAST(i AS BIGINT) i, CAST(j AS BIGINT) j, CAST(7 AS BIGINT) f, CAST(0 AS BIGINT) z, CAST(1 AS BIGINT) o, CAST(5 AS BIGINT) l FROM range(4) x(i), range(3) y(j)")
def create_constants(spark, sf_dir):
    f = cf.full((4, 3), 7)
    made = {"f": f, "z": cf.zeros_like(f) + cf.empty_like(f), "o": cf.ones_like(f), "l": cf.full_like(f, 5)}
    out = None
    for name, t in made.items():
        part = cells(t, "i", "j", value=name, dense=True)
        out = part if out is None else out.join(part, ["i", "j"])
    return out


_MASKS = {
    "mask_upper": (lambda: cf.upper_triangle(40, 30, 2), "j - i >= 2", 40, 30),
    "mask_lower": (lambda: cf.lower_triangle(30, 40, -1), "j - i <= -1", 30, 40),
    "mask_reverse": (lambda: cf.reverse_tensor(50), "j = 49 - i", 50, 50),
    "mask_roll": (lambda: cf.roll_tensor(50, 3), "j = (i + 47) % 50", 50, 50),
    "mask_repeat": (lambda: cf.repeat_tensor(20, 3), "j = i // 3", 60, 20),
}
for _name, (_make_mask, _test, _n, _m) in _MASKS.items():

    def _run_mask(spark, sf_dir, make=_make_mask):
        return cells(make(), "i", "j")

    query(_name, f"SELECT CAST(i AS BIGINT) i, CAST(j AS BIGINT) j, true v FROM range({_n}) x(i), range({_m}) y(j) WHERE {_test}")(_run_mask)


@query("mask_vectors", "SELECT CAST(i AS BIGINT) i, i % 2 = 1 p, i = 6 o FROM range(20) t(i)")
def mask_vectors(spark, sf_dir):
    p = cf.parity_mask(20, odd=True)
    return columns(p, {"p": p, "o": cf.one_hot(20, 6)}, "i")


@query("reduce_custom_init", f"WITH {_M} SELECT i k, CAST(100 + SUM(v) AS BIGINT) a, GREATEST(9, MAX(v)) m FROM M GROUP BY 1")
def reduce_custom_init(spark, sf_dir):
    m = grid(spark, sf_dir)
    return columns(m, {"a": cf.reduce("add", m, axis=1, init=100), "m": cf.max(m, axis=1, init=9), "n": cf.any(m, axis=1)}, "k").where("n").drop("n")


@query("sort_vector", "SELECT ROW_NUMBER() OVER (ORDER BY c_acctbal, c_custkey) - 1 r, c_acctbal v, c_custkey a FROM customer")
def sort_vector(spark, sf_dir):
    b = balances(spark, sf_dir)
    return columns(b, {"v": cf.sort(b), "a": cf.argsort(b)}, "r")


@query("cumulative_vector", "SELECT c_custkey k, CAST(SUM(CAST(ROUND(c_acctbal * 100) AS BIGINT)) OVER (ORDER BY c_custkey) AS BIGINT) s, MAX(CAST(ROUND(c_acctbal * 100) AS BIGINT)) OVER (ORDER BY c_custkey) m FROM customer")
def cumulative_vector(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumn("c", F.round(F.col("c_acctbal") * 100).cast("bigint"))
    c = from_relation(customer, ["c_custkey"], "c", extent(customer, "c_custkey"))
    return columns(c, {"s": cf.cumulative_sum(c), "m": cf.cumulative("maximum", c)}, "k")


@query("events_windowed", "SELECT date_trunc('hour', ts) w, user_id u, COUNT(*) v FROM events GROUP BY 1, 2")
def events_windowed(spark, sf_dir):
    from .streaming.aggregate import windowed_cells

    got = windowed_cells(table(spark, sf_dir, "events"), "ts", ["user_id"], None)
    return got.select(F.col("window.start").alias("w"), F.col("i0").alias("u"), F.col("v"))
