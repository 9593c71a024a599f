"""Vectors of whole numbers: which rows take part, how components are rounded, exact inner products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str | Column) -> Column:
    """Whether a vector is there and all its components are numbers; never null."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole(vector: str, scale: int, largest: str | Column) -> Column:
    """Each component times ``scale``, rounded down; one beyond ``largest`` is an error, so that nothing overflows unseen."""
    most = F.expr(largest) if isinstance(largest, str) else largest
    too_large = F.raise_error(F.lit("a component is too large for exact whole numbers")).cast("bigint")
    return F.transform(vector, lambda x: F.when(F.abs(x) * scale <= most, F.floor(x * scale)).otherwise(too_large))


def whole_rows(vectors: DataFrame, scale: int, id_col: str, vector_col: str, *more: Column) -> DataFrame:
    """(id, v, h, n2 and ``more``) of the rows that take part, each once: id there, vector finite; n2 is the squared length.

    Components may be as large as lets an inner product of two such vectors fit a long.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("f"), *more)
    rows = rows.where(F.col("id").isNotNull() & finite("f"))
    kept = rows.withColumn("v", whole("f", scale, F.sqrt(F.lit(2.0**62) / F.greatest(F.size("f"), F.lit(1))))).drop("f").distinct()
    length = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    return kept.withColumn("h", F.xxhash64(F.lit(41), "v")).withColumn("n2", length)


def matrix(column: pa.ChunkedArray, kind: type = np.int64) -> np.ndarray:
    """A column of equally long lists as one array, without Python lists between."""
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return np.asarray(flat.flatten()).astype(kind, copy=False).reshape(len(flat), -1) if len(flat) and len(flat.flatten()) else np.zeros((len(flat), 0), kind)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: as doubles where those are exact, else as longs."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), np.int64)
    top = a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max())
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T
