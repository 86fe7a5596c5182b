"""Text lines with a stable order, from many files in one scan."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Room for files of up to 16 TiB below the file number.
FILE_SHIFT = 44


# Fixed pattern: scheme of a path, which comes with one slash or three for local files.
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):/+"


def file_column() -> Column:
    """Path of the file a row was read from; one of those that ``file_table`` lists for it."""
    return F.col("_metadata.file_path")


def file_table(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file_path, file_ord``: the files behind the paths in argument order, once for each way to write the scheme.

    Only names travel to and from the driver, which lists them for any scan.
    """
    found = [f for p in paths for f in sorted(spark.read.text(p).inputFiles())]
    names = dict.fromkeys(re.sub(SCHEME, r"\1:/", f) for f in found)
    ways = [(re.sub(SCHEME, rf"\1:{slashes}", f), i) for i, f in enumerate(names) for slashes in ("/", "//", "///")]
    return spark.createDataFrame(list(dict.fromkeys(ways)), "file_path string, file_ord long")


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file_path, value``: lines with blanks at both ends removed, empty ones dropped.

    Gzip is decoded by extension. Lines that start with ``#`` are kept.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(paths).select(
        file_column().alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.btrim("value", F.lit(" \t\r\n")).alias("value"),
    )
    return lines.filter(F.col("value") != "")


def with_line_order(lines: DataFrame, paths: str | Sequence[str], out: str) -> DataFrame:
    """Adds ``out``: rises with argument order of the paths, then with the line.

    Within a file the number is the byte offset of the split plus the row number
    inside the task. A full split fills a task alone and holds fewer rows than
    bytes, so numbers of one file never cross. The list of files goes to the
    lines: joined otherwise, each file's lines would meet in one task.
    """
    spark = lines.sparkSession
    paths = [paths] if isinstance(paths, str) else list(paths)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = lines.withColumn("__row", row + F.col("block_start"))
    return (
        numbered.join(F.broadcast(file_table(spark, paths)), "file_path")
        .withColumn(out, F.shiftleft("file_ord", FILE_SHIFT) + F.col("__row"))
        .drop("__row", "file_ord", "block_start", "file_path")
    )
