"""Shared helpers: intermediate tables, folds, bounded training samples."""

from __future__ import annotations

import ctypes
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace that separates words in every word contract of this package.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    It is the shared folder named in ``spark.checkpoint.dir``, or else the session's checkpoint folder.  Where neither
    is set, a temporary folder is made if Spark runs in this process alone, as in tests; a cluster
    must name one, since no folder of a single machine would do.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="coordframe-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class Workspace:
    """Intermediate tables of one operator call, written once to the shared folder.

    Written tables cut lineage: a lost executor makes Spark reread files, not recompute.
    ``drop`` removes tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def release() -> None:
    """Gives memory that is free back to the system: Spark keeps Python workers between tasks, beside other stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker keeps no memory of it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text (fold 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def unit_hash(col: Column, seed: int) -> Column:
    """A value in [0, 1) that depends on the column and the seed only."""
    return F.pmod(F.xxhash64(col, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def class_sample(labelled: DataFrame, rows: int, seed: int) -> DataFrame:
    """A hash-chosen sample of ``(doc_id, label)`` of about ``rows`` rows, equal by class.

    Classes that have fewer rows than their share give all of them.  The choice depends on doc_id
    only, so it is the same in every run.  The number of classes must be small.
    """
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return labelled.limit(0)
    share = rows / len(counts)
    rate = F.lit(0.0)
    for label, n in sorted(counts.items()):
        rate = F.when(F.col("label") == F.lit(label), F.lit(min(1.0, share / n))).otherwise(rate)
    return labelled.where(unit_hash(F.col("doc_id"), seed) < rate)


def labelled_texts(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held_out: int, rows: int, max_chars: int, seed: int = 7) -> DataFrame:
    """The bounded training sample of a classifier, as ``doc_id, text, label``.

    Only rows outside the held-out fold are read.  ``rows`` bounds the sample (in expectation, by
    hash of the id) and only texts of at most ``max_chars`` characters are learned from; scoring
    has no such bound.  Ids labelled several times count once, with the largest label; of several texts with one id the smallest is taken.
    """
    lab = (
        labels.select(F.col("doc_id"), F.col(target).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id"), modulus) != held_out))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    chosen = class_sample(lab, rows, seed)
    ids = chosen.limit(4 * rows + 1000).collect()
    if len(ids) > 2 * rows + 500:
        raise RuntimeError(f"{len(ids)} ids in a sample of {rows}")
    few = docs.sparkSession.createDataFrame(ids, chosen.schema)
    got = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars)).join(F.broadcast(few), "doc_id")
    return got.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def fitted[M](sample: DataFrame, train: Callable[[list[tuple]], M]) -> M:
    """What ``train`` makes of the ``(text, label)`` rows of ``sample(doc_id, text, label)``, in the order of doc_id.

    The sample is bounded, so one task holds it; the driver gets nothing but the model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:2])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([r[1:] for r in rows]))], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(released(run), "model binary").first()
    return pickle.loads(found["model"]) if found else train([])
