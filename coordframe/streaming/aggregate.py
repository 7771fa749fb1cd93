"""Tensors over streams: a windowed coordinate table that folds as events arrive.  An extension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import types as T
from ..functions.registry import OPS
from ..relation import VALUE, _grouped
from ..tensor import axis_names


def windowed_cells(events: DataFrame, time: str, index: Sequence[str], value: str | None, *, op: str = "add", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(window, i0, .., v)``: the fold of each window's events by coordinate.

    Works on streams and tables alike.  Events later than the watermark are dropped by Structured Streaming; rows with a null
    coordinate or value are no cells.
    """
    names = axis_names(len(index))
    col = F.lit(1).cast("bigint") if value is None else F.col(value)
    cells = events.withWatermark(time, late).select(F.col(time).alias("__t"), *[F.col(c).cast("bigint").alias(n) for c, n in zip(index, names, strict=True)], col.alias(VALUE)).dropna()
    kind = T.from_spark(cells.schema[VALUE].dataType.simpleString())
    return cells.groupBy(F.window("__t", window).alias("window"), *names).agg(_grouped(OPS[op], kind, kind).alias(VALUE))
