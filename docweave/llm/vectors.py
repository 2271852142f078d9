"""What the vector searches share: usable vectors, copies, batches as matrices, ranked lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor empty, and all components finite."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def dimensions(vectors: DataFrame, column: str) -> list[int]:
    """The lengths of vectors that occur. Only vectors of equal length are compared."""
    return sorted(r[0] for r in vectors.select(F.size(column).alias("d")).distinct().collect())


def first_copies(vectors: DataFrame, n: int) -> DataFrame:
    """Of the vec_ids of equal vectors the n smallest. As copies score alike and ties go to the smaller vec_id, no other can be among the n - 1 best of a query.

    Rows that repeat a vec_id and its vector count once. The limit is applied before the shuffle too, so a vector that a third of all rows hold leaves n rows a task.
    """
    order = Window.partitionBy("vector").orderBy("vec_id")
    once = vectors.withColumn("_rank", F.dense_rank().over(order)).where(F.col("_rank") <= n)
    return once.dropDuplicates(["vector", "vec_id"]).drop("_rank")


def matrix(column: pa.Array, d: int, kind) -> np.ndarray:
    """A list column, all lists of length d, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, d)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of (query_id, vec_id, score), ties to the smaller vec_id."""
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
