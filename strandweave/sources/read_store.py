"""Aligned reads as Parquet that is read by place: folders by sample, track and contig, rows by position bin.

A read has a row in every bin that it touches, so a window needs its own bins
only. Folder names carry a letter before the sample's and the track's name, as
an empty name could not be a folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.sources.lookup import in_bins

BIN = 16_384
FOLDERS = ["sample_folder", "track_folder", "chrom_folder"]


def _folder(letter: str, name):
    return F.concat(F.lit(letter), name)


def write_reads(reads: DataFrame, path: str, bin_width: int = BIN) -> None:
    """Stores reads (1-based inclusive ``start, end``; ``sample_id``, ``track`` and ``chrom``, not null) in order of place.

    Range partitioning spreads a contig that holds most reads over several
    files, and row groups sorted by bin let a reader skip what it does not ask for.
    """
    placed = in_bins(reads.withColumn("__from", F.col("start") - 1), "__from", "end", bin_width).drop("__from")
    placed = placed.withColumns({
        "sample_folder": _folder("s", F.col("sample_id")), "track_folder": _folder("t", F.col("track")), "chrom_folder": _folder("c", F.col("chrom"))})
    order = [*FOLDERS, "bin", "start"]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").partitionBy(*FOLDERS).mode("overwrite").parquet(path)


def open_reads(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with ``bin`` and ``first_bin``; those with ``bin = first_bin`` are the reads themselves."""
    return spark.read.parquet(path)


def read_window(
    spark: SparkSession, path: str, chrom: str, start: int, end: int,
    sample_ids: Sequence[str] | None = None, tracks: Sequence[str] | None = None, bin_width: int = BIN,
) -> DataFrame:
    """Reads that share a base with ``chrom:start-end`` (1-based inclusive), of all or the named samples and tracks.

    Other folders are not listed for reading, other bins are skipped by the
    statistics of their row groups.
    """
    rows = open_reads(spark, path).where(F.col("chrom_folder") == f"c{chrom}")
    if sample_ids is not None:
        rows = rows.where(F.col("sample_folder").isin([f"s{s}" for s in sample_ids]))
    if tracks is not None:
        rows = rows.where(F.col("track_folder").isin([f"t{t}" for t in tracks]))
    low, high = (max(p - 1, 0) // bin_width for p in (start, end))
    rows = rows.where((F.col("bin") >= low) & (F.col("bin") <= high) & (F.col("bin") == F.greatest("first_bin", F.lit(low))))
    return rows.where((F.col("start") <= end) & (F.col("end") >= start)).drop("bin", "first_bin", *FOLDERS)


def reads_of_regions(regions: DataFrame, stored: DataFrame, bin_width: int = BIN) -> DataFrame:
    """``reads_in_regions`` from the store: each region with the reads that share a base with it.

    Regions are dealt by folder and bin; few of them prune the folders while
    the job runs. ``stored`` comes from ``open_reads`` and may be cut to tracks.
    """
    asked = regions.select(
        "region_id", "sample_id", "chrom", F.col("start").alias("view_start"), F.col("end").alias("view_end"),
        _folder("s", F.col("sample_id")).alias("sample_folder"), _folder("c", F.col("chrom")).alias("chrom_folder"),
    ).where("view_end >= view_start")
    asked = in_bins(asked.withColumn("__from", F.col("view_start") - 1), "__from", "view_end", bin_width).drop("__from")
    asked = asked.withColumnRenamed("first_bin", "view_bin")
    pairs = asked.join(stored.drop("sample_id", "chrom"), ["sample_folder", "chrom_folder", "bin"])
    pairs = pairs.where((F.col("bin") == F.greatest("first_bin", "view_bin")) & (F.col("start") <= F.col("view_end")) & (F.col("end") >= F.col("view_start")))
    return pairs.drop("bin", "first_bin", "view_bin", *FOLDERS)

