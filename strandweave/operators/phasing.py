"""Read phasing by competing alignment scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions import sam


def best_scores(reads: DataFrame, key: Sequence[str] = ("name",)) -> DataFrame:
    """Highest alignment score per read name over its mapped alignments.

    Where names of several samples meet, the key takes ``sample_id`` as well; so
    below.
    """
    scored = reads.filter(sam.has_score(F.col("flags"), F.col("as_score")))
    return scored.groupBy(*key).agg(F.max("as_score").alias("score"))


def assign_hp(s1: Column, s2: Column, tolerance: int = 0) -> Column:
    """1 or 2 for the clearly better haplotype, 0 within the tolerance."""
    diff = s1 - s2
    return (
        F.when(s2.isNull(), F.when(s1.isNotNull(), 1))
        .when(s1.isNull(), 2)
        .when(diff > tolerance, 1)
        .when(diff < -tolerance, 2)
        .otherwise(0)
    )


def phase_reads(hap1: DataFrame, hap2: DataFrame, tolerance: int = 0, key: Sequence[str] = ("name",)) -> DataFrame:
    """``key, hp`` from alignments of the same reads to both haplotypes."""
    one = best_scores(hap1, key).withColumnRenamed("score", "s1")
    two = best_scores(hap2, key).withColumnRenamed("score", "s2")
    both = one.join(two, list(key), "full_outer")
    return both.select(*key, assign_hp(F.col("s1"), F.col("s2"), tolerance).alias("hp"))


def phase_counts(phase: DataFrame) -> DataFrame:
    """One row with the number of reads per assignment; zeros are kept."""
    return phase.agg(
        F.count_if(F.col("hp") == 1).alias("hap1"),
        F.count_if(F.col("hp") == 2).alias("hap2"),
        F.count_if(F.col("hp") == 0).alias("ambiguous"),
    )


def tag_reads(reads: DataFrame, phase: DataFrame, key: Sequence[str] = ("name",)) -> DataFrame:
    """Reads with the new assignment; unassigned reads keep the one they had.

    Where reads carry their SAM ``line``, its HP tag follows.
    """
    new = phase.select(*key, F.col("hp").alias("__hp"))
    tagged = reads.join(new, list(key), "left")
    if "line" in reads.columns:
        f = F.split("line", "\t")
        tags = F.filter(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), lambda t: ~t.startswith("HP:"))
        renewed = F.concat(F.slice(f, 1, 11), tags, F.array(F.concat(F.lit("HP:i:"), F.col("__hp").cast("string"))))
        tagged = tagged.withColumn("line", F.when(F.col("__hp").isNotNull(), F.array_join(renewed, "\t")).otherwise(F.col("line")))
    return tagged.withColumn("hp", F.coalesce("__hp", "hp")).drop("__hp")
