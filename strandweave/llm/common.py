"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.session import scratch_folder

#: Words are runs of characters other than blanks and the five control blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, label: str, **options) -> DataFrame:
    """Writes ``df`` to the shared scratch folder, with further Parquet ``options``, and reads it back.

    This cuts the lineage, so a costly stage runs once however often its rows
    are used, and lets Spark plan with the true size of what it reads.
    """
    path = scratch_folder(df.sparkSession, label)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(batches: Iterable[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``size`` bytes, a row at least, none of them copied.

    What a worker makes of a batch, such as its texts as Python objects, is several times the batch and stays with the
    worker after its task, beside the executor's heap. At the end unused Arrow memory is given back.
    """
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    pa.default_memory_pool().release_unused()


def running_total(df: DataFrame, order: str, value: str, out: str, width: int = 4096) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows of smaller ``order``.

    ``order`` is a long, unique per row. Totals of ``width`` neighbours are
    summed first, so no task sorts more than ``width`` rows or one row per
    ``width``.
    """
    group = F.floor(F.col(order) / width).cast("long")
    rows = df.withColumn("_group", group)
    sums = rows.groupBy("_group").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_group", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(bases, "_group").withColumn(out, F.col("_base") + F.col("_inner")).drop("_group", "_base", "_inner")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
