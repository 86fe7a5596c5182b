"""Aligned reads from SAM text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import cigar as C
from strandweave.functions import sam
from strandweave.sources.lines import read_lines, with_line_order

# The nine tracks a region panel shows, by panel.
PANEL_TRACKS = {
    "ref": ("reads_to_ref", "hap1_to_ref", "hap2_to_ref"),
    "hap1": ("reads_to_hap1", "ref_to_hap1", "hap2_to_hap1"),
    "hap2": ("reads_to_hap2", "ref_to_hap2", "hap1_to_hap2"),
}


def read_sam(
    spark: SparkSession, paths: str | Sequence[str], sample_id: str = "", track: str = ""
) -> DataFrame:
    """Mapped reads of SAM text files; header and short lines are dropped.

    Positions are 1-based inclusive. ``line`` keeps the whole record for
    subsetting; Spark does not carry it when it is not used.
    """
    lines = read_lines(spark, paths)
    f = F.split("value", "\t")
    lines = lines.filter(~F.col("value").startswith("@") & (F.size(f) >= 11))
    rows = with_line_order(lines, paths, "read_seq").withColumn("f", f)
    rows = rows.filter(sam.is_mapped(F.col("f")[1].cast("int")))
    tags = F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0)))
    start, cigar = F.col("f")[3].cast("bigint"), F.col("f")[5]
    return rows.select(
        F.lit(sample_id).alias("sample_id"),
        F.lit(track).alias("track"),
        "read_seq",
        F.col("f")[0].alias("name"),
        F.col("f")[2].alias("chrom"),
        start.alias("start"),
        C.alignment_end(start, cigar).alias("end"),
        sam.has_flag(F.col("f")[1].cast("int"), sam.REVERSED).alias("is_reverse"),
        _known_mapq(F.col("f")[4].cast("int")).alias("mapq"),
        sam.int_tag(tags, "HP").alias("hp"),
        F.col("f")[1].cast("int").alias("flags"),
        cigar.alias("cigar"),
        sam.int_tag(tags, "AS").alias("as_score"),
        F.col("value").alias("line"),
    ).filter(F.col("start") >= 1)


def _known_mapq(mapq: Column) -> Column:
    """255 stands for an unknown mapping quality."""
    return F.when(mapq != 255, mapq)


def label_tracks(tracks: dict[str, DataFrame]) -> DataFrame:
    """One table of the reads of several tracks, each under its track name."""
    labelled = [df.withColumn("track", F.lit(name)) for name, df in tracks.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)
