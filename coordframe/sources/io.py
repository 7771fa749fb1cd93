"""Tensors from and to files, as coordinate tables.  An extension: arrays in memory are the main source."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .. import types as T
from ..relation import VALUE, Relation
from ..tensor import Tensor, axis_names, dims_of, from_relation


def read_table(spark: SparkSession, path: str, index: Sequence[str], value: str | None, shape: Sequence[int], *, format: str = "parquet", **kwargs) -> Tensor:
    """A tensor over a stored table; only the named columns are read."""
    return from_relation(spark.read.format(format).load(path), index, value, shape, **kwargs)


def write_tensor(x: Tensor, path: str, *, format: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """The stored cells, with shape, fill and dtype as metadata of the value column."""
    about = {"shape": list(x.shape), "fill": str(np.asarray(x.fill_value)), "dtype": x.dtype.name}
    df = x.df.withMetadata(VALUE, {"coordframe": json.dumps(about)})
    df.write.format(format).mode(mode).partitionBy(*partition_by).save(path)


def read_tensor(spark: SparkSession, path: str, *, format: str = "parquet") -> Tensor:
    """A tensor written by write_tensor."""
    df = spark.read.format(format).load(path)
    about = json.loads(df.schema[VALUE].metadata["coordframe"])
    dtype = T.as_dtype(about["dtype"])
    fill = complex(about["fill"]) if dtype.kind == "c" else {"True": True, "False": False}.get(about["fill"], about["fill"])
    fill = np.asarray(fill).astype(dtype)[()]
    names = axis_names(len(about["shape"]))
    return Tensor(Relation(df.select(*names, VALUE), names, dims_of(about["shape"]), fill, dtype))


def embedding_matrix(df: DataFrame, row: str, vector: str, rows: int, width: int) -> Tensor:
    """A matrix from a column of arrays: one row for each key, nulls left out."""
    from pyspark.sql import functions as F

    cells = df.select(F.col(row).cast("bigint").alias("i0"), F.posexplode(vector).alias("i1", VALUE)).select("i0", F.col("i1").cast("bigint").alias("i1"), VALUE)
    return from_relation(cells, ["i0", "i1"], VALUE, (rows, width), reduce=None)
