"""Vectors in blocks: which rows take part, and each block of rows with each block of queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS = 8192
QUERIES = 4096


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, v`` (array of double) of the rows that take part; a null id takes no part, as it cannot be told.

    Rows that repeat an id with the same vector count once.
    """
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id is not null")
    return rows.where(usable(F.col("v"))).distinct()


def tiled(rows: DataFrame, queries: DataFrame, run, schema: str, block_rows: int = ROWS, block_queries: int = QUERIES) -> DataFrame:
    """``run(key, row frame, query frame)`` for each pair of blocks of rows and of queries.

    Blocks are dealt by a hash of the id, so copies of one vector spread over all
    blocks; each holds about ``block_rows`` rows, however many there are. Vectors
    of other lengths than a query's are not compared with it.
    """
    n_rows, n_queries = rows.count(), queries.count()
    a, b = max(1, -(-n_rows // block_rows)), max(1, -(-n_queries // block_queries))
    rows = rows.withColumn("size", F.size("v")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(a)).cast("int"))
    queries = queries.withColumn("size", F.size("v")).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(b)).cast("int"))
    left = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    right = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(a - 1))))
    keys = ["size", "block", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of highest score of each query, ties to the smaller id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def stack(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]
