"""Embedding near-duplicates: product quantisation with coarse inverted lists and an exact rerank.

Unit vectors fall into coarse cells; what remains beside a cell's centre is coded by the nearest
codeword of each subspace.  A query looks at the cells that can hold a vector within its radius, sums
table entries over each code (asymmetric distances), and reranks what is left by the exact cosine.

Let r be the radius that the cosine sets.  A code is skipped only when its distance exceeds r plus that vector's
coding error, which loses nothing.  A cell is skipped only when the bisector between it and the query's own cell is more than
``min(1, PROBE / sqrt(dim)) r`` away: a difference of length r reaches beyond that only if it points at the other
cell's centre, for a random one with a probability of 3e-7 (PROBE = 5 standard deviations), and the pair is looked for from both of its
sides.  Up to 25 dimensions the factor is 1 and nothing can be lost.  Probes by r itself would be half of all cells at 64 dimensions.
Equal vectors form one class with a count first, named by the number of one of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, unit_hash
from .components import connected_components

SUBSPACES, CODEWORDS, BLOCK, MAX_CELLS, PROBE = 8, 64, 2048, 1024, 5.0


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = total[n > 0] / n[n > 0][:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    half = (centres**2).sum(axis=1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmax(x[i : i + 4096] @ centres.T - half, axis=1)
    return out


class Quantiser:
    """Coarse centres and the codewords of each subspace, fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.centres = _kmeans(sample, max(1, min(cells, len(sample))), 8, rng)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.bounds = np.linspace(0, self.dim, min(SUBSPACES, self.dim) + 1).astype(int)
        self.words = [_kmeans(rest[:, a:b], min(CODEWORDS, len(rest)), 6, rng) for a, b in zip(self.bounds, self.bounds[1:], strict=False)]
        sq = (self.centres**2).sum(axis=1)
        self.gaps = np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * self.centres @ self.centres.T, 1e-18))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(cell, codes, coding error)`` of unit vectors."""
        cell = nearest(x, self.centres)
        rest = x - self.centres[cell]
        codes = np.stack([nearest(rest[:, a:b], w) for (a, b), w in zip(zip(self.bounds, self.bounds[1:], strict=False), self.words, strict=True)], axis=1).astype(np.uint8)
        return cell, codes, np.sqrt(((rest - self.decode(codes)) ** 2).sum(axis=1))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([w[codes[:, j]] for j, w in enumerate(self.words)], axis=1)

    def probes(self, x: np.ndarray, cell: np.ndarray, radius: float) -> np.ndarray:
        """Which cells lie within the probing distance of each query: a matrix of booleans."""
        radius *= min(1.0, PROBE / self.dim**0.5)
        d = (self.centres**2).sum(axis=1)[None] - 2 * x @ self.centres.T
        own = d[np.arange(len(x)), cell][:, None]
        out = (d - own) / (2 * self.gaps[cell]) <= radius + 1e-9
        out[np.arange(len(x)), cell] = True
        return out

    def distances(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the codes of one cell: a sum of table entries."""
        rest = x - self.centres[cell]
        total = np.zeros((len(x), len(codes)))
        for j, w in enumerate(self.words):
            part = rest[:, self.bounds[j] : self.bounds[j + 1]]
            table = (part**2).sum(axis=1)[:, None] + (w**2).sum(axis=1)[None] - 2 * part @ w.T
            total += table[:, codes[:, j]]
        return np.sqrt(np.maximum(total, 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def near_duplicates(spark: SparkSession, vectors: DataFrame, cosine: float = 0.98, sample_rows: int = 20_000, cells: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding, label)``.

    Vectors of equal non-null labels and equal length link when their cosine in double precision reaches ``cosine``.
    Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing.  Repeated rows link as any others, whatever their vec_id.  Each length has its quantiser, all fitted on about ``sample_rows`` classes
    together, chosen by hash, and one at least of each length; every row is indexed.  component_id is the smallest vec_id reachable.
    No rows give no rows; other columns are not looked at.
    """
    ws = Workspace(spark, "pq")
    e = F.col("embedding")
    if not isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType):  # floats travel as they are, all others as doubles
        e = e.cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), e.alias("v"), F.monotonically_increasing_id().alias("row"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("good", good)
    # equal vectors are one class; -0.0 equals 0.0 as a value
    key = F.when(F.col("good"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x.cast("double")).cast("string"))), 256))
    rows = rows.withColumn("key", key)
    classes = rows.where("good").groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("k"), F.first("label").alias("label"), F.first("v").alias("v"), F.min("row").alias("cls"))
    classes = classes.withColumn("dim", F.size("v"))
    classes = ws.table("classes", classes)
    ids = ws.table("ids", rows.select("vec_id", "key"))

    def finish(counts: DataFrame | None, edges: DataFrame | None) -> DataFrame:
        named = classes.select("key", "cls", "k", "low")
        if counts is None:
            named = named.withColumn("more", F.lit(0).cast("long")).withColumn("component", F.col("cls"))
        else:
            comp = connected_components(spark, edges).withColumnRenamed("node", "cls")
            total = counts.groupBy("cls").agg(F.sum("n").alias("more"))
            named = named.join(total, "cls", "left").join(comp, "cls", "left")
            named = named.withColumn("more", F.coalesce("more", F.lit(0))).withColumn("component", F.coalesce("component", "cls"))
        lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
        named = named.join(lowest, "component").select("key", (F.col("k") - 1 + F.col("more")).cast("long").alias("n_links"), "component_id")
        out = ids.join(named, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

    lengths = {r["dim"]: r for r in classes.groupBy("dim").agg(F.count("*").alias("n"), F.min_by("v", "key").alias("v")).collect()}  # few, a row for each
    n_classes = sum(r["n"] for r in lengths.values())
    if not lengths:
        return finish(None, None)
    sample = classes.where(unit_hash(F.col("key"), 3) < min(1.0, sample_rows / n_classes)).select("dim", "key", "v").collect()
    sample.sort(key=lambda r: r["key"])
    quantisers = {}
    for dim, r in sorted(lengths.items()):
        x = np.array([s["v"] for s in sample if s["dim"] == dim] or [r["v"]])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        quantisers[dim] = Quantiser(x, cells or min(MAX_CELLS, max(1, int(r["n"] ** 0.5 / 4))))
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class with its cell, codes and probes."""
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                mixed = batch.slice(at, 1024)
                dims = mixed.column(4).to_numpy()
                for dim in np.unique(dims).tolist():
                    part, quantiser = mixed.filter(pa.array(dims == dim)), quantisers[dim]
                    v = _matrix(part.column(3), dim)
                    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                    cell, codes, error = quantiser.encode(unit)
                    probe = [np.flatnonzero(p).tolist() for p in quantiser.probes(unit, cell, radius)]
                    columns = [*(part.column(i) for i in range(5)), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(error), pa.array(probe, pa.list_(pa.int32()))], ["cls", "label", "k", "v", "dim", "cell", "code", "error", "probes"])

    kind, vector = (classes.schema[c].dataType.simpleString() for c in ("label", "v"))
    coded = classes.select("cls", "label", "k", "v", "dim").mapInArrow(index, f"cls long, label {kind}, k long, v {vector}, dim int, cell int, code binary, error double, probes array<int>")
    coded = ws.table("coded", coded)
    # a list of any length is parted into blocks of about BLOCK vectors; each query visits each block of its lists
    sizes = coded.groupBy("label", "dim", "cell").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    sizes = ws.table("sizes", sizes)
    items = coded.join(sizes, ["label", "dim", "cell"]).withColumn("part", F.pmod("cls", "parts").cast("int"))
    items = items.select("label", "dim", "cell", "part", F.lit(True).alias("item"), "cls", "k", "v", "code", "error", F.col("cell").alias("home"), "probes")
    asked = coded.withColumn("probe", F.explode("probes")).withColumnRenamed("cell", "home").withColumnRenamed("probe", "cell").join(sizes, ["label", "dim", "cell"])
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.select("label", "dim", "cell", "part", F.lit(False).alias("item"), "cls", "k", "v", "code", "error", "home", "probes").drop("code", "error")
    both = items.unionByName(asked, allowMissingColumns=True)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (label, dim, cell, part), a block's vectors before its queries, which stream by."""
        block, block_key, wait, wait_key = None, None, [], None

        def compare(part: pa.RecordBatch) -> pa.RecordBatch | None:
            dim = part.column("dim")[0].as_py()
            cell = part.column("cell")[0].as_py()
            qid, qk = part.column("cls").to_numpy(), part.column("k").to_numpy()
            q = _matrix(part.column("v"), dim)
            qn = np.linalg.norm(q, axis=1)
            home = part.column("home").to_numpy()
            ids, k, v, norm, codes, error, probes = block
            close = quantisers[dim].distances(q / qn[:, None], cell, codes) <= radius + error[None] + 1e-7
            close &= qid[:, None] != ids[None]
            a, b = np.nonzero(close)
            if not len(a):
                return None
            dot = np.concatenate([np.einsum("ij,ij->i", q[a[i : i + 65536]], v[b[i : i + 65536]]) for i in range(0, len(a), 65536)])
            ok = dot / (qn[a] * norm[b]) >= cosine
            a, b = a[ok], b[ok]
            if not len(a):
                return None
            # the pair is met again from the other side if b looks into a's home cell
            back = probes[b, home[a]]
            n_q = np.bincount(a, k[b], minlength=len(qid)).astype(np.int64)
            n_i = np.bincount(b[~back], qk[a[~back]], minlength=len(ids)).astype(np.int64)
            # edges: a star for each component of what was found here
            label = np.arange(len(qid) + len(ids))
            while True:
                old = label.copy()
                np.minimum.at(label, a, label[len(qid) + b])
                np.minimum.at(label, len(qid) + b, label[a])
                if (old == label).all():
                    break
            nodes = np.r_[qid, ids]
            far = np.flatnonzero(label != np.arange(len(label)))
            x, y = nodes[far], nodes[label[far]]
            some_q, some_i = np.flatnonzero(n_q), np.flatnonzero(n_i)
            cls = np.r_[qid[some_q], ids[some_i], x]
            n = np.r_[n_q[some_q], n_i[some_i], np.zeros(len(x), dtype=np.int64)]
            other = pa.array(np.r_[np.zeros(len(some_q) + len(some_i), dtype=np.int64), y], mask=np.r_[np.ones(len(some_q) + len(some_i), dtype=bool), np.zeros(len(y), dtype=bool)])
            return pa.RecordBatch.from_arrays([pa.array(cls), pa.array(n), other], ["cls", "n", "other"])

        def built(parts: list[pa.RecordBatch]):
            t = pa.Table.from_batches(parts).combine_chunks()
            dim = t.column("dim")[0].as_py()
            v = _matrix(t.column("v").chunk(0), dim)
            probes = np.zeros((len(v), len(quantisers[dim].centres)), dtype=bool)
            for i, p in enumerate(t.column("probes").to_pylist()):
                probes[i, p] = True
            codes = np.frombuffer(b"".join(t.column("code").to_pylist()), dtype=np.uint8).reshape(len(v), -1)
            return t.column("cls").to_numpy(), t.column("k").to_numpy(), v, np.linalg.norm(v, axis=1), codes, t.column("error").to_numpy(), probes

        for batch in batches:
            marks = [tuple(r.values()) for r in batch.select(["label", "dim", "cell", "part", "item"]).to_pylist()]
            cuts = [0, *[i for i in range(1, len(marks)) if marks[i] != marks[i - 1]], len(marks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                here, item = marks[a][:4], marks[a][4]
                if item:
                    if here != wait_key:
                        wait, wait_key = [], here
                    wait.append(batch.slice(a, b - a))
                    continue
                if here != block_key:
                    block_key = here
                    block = built(wait) if wait and wait_key == here else None
                    wait, wait_key = [], None
                if block is not None:
                    for i in range(a, b, 512):
                        if (found := compare(batch.slice(i, min(512, b - i)))) is not None:
                            yield found

    cols = both.select("label", "dim", "cell", "part", "item", "cls", "k", "v", "code", "error", "home", "probes")
    found = cols.repartition("label", "dim", "cell", "part").sortWithinPartitions("label", "dim", "cell", "part", F.desc("item")).mapInArrow(search, "cls long, n long, other long")
    found = ws.table("found", found)
    edges = found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b"))
    out = ws.table("out", finish(found.where("other is null").select("cls", "n"), edges))
    ws.drop("classes", "ids", "coded", "sizes", "found")
    return out
