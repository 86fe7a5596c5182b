"""Phase reads by their scores on both haplotypes and tag every track with the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.phasing import phase_counts, phase_reads, tag_reads


def phase_and_tag(reads: DataFrame, tolerance: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(phase, counts, tagged reads)`` from a table holding all tracks of all samples."""
    key = ("sample_id", "name")
    phase = phase_reads(
        reads.filter(F.col("track") == "hap1"), reads.filter(F.col("track") == "hap2"), tolerance, key
    )
    return phase, phase_counts(phase), tag_reads(reads, phase, key)
