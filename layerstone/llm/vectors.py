"""What the two vector searches share: usable vectors, Arrow matrices, best rows of each query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(embeddings: DataFrame, zero: bool) -> DataFrame:
    """row (a number of our own), vec_id, v, dim of the vectors without nulls and non-finite components; zero: whether zero vectors count."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    if not zero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    return rows.withColumn("dim", F.size("v"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as float64 rows."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = pa.concat_arrays([c.flatten() for c in chunks]).to_numpy(zero_copy_only=False) if chunks else np.zeros(0)
    return flat.astype(np.float64).reshape(len(column), -1)


def lists(values: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as a list column of doubles."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values, np.float64).ravel()))


def ranked(found: DataFrame, k: int, *order: Column) -> DataFrame:
    """found with rank, the first k of each query. Rows are cut to k a query before and after the shuffle."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
