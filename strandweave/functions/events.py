"""Structural-variant events between two flanking alignment blocks.

``prev`` and ``nxt`` are struct columns with the fields ``ref_start, ref_end,
asm_chrom, asm_start, asm_end, strand, mapq``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def assembly_gap(prev: Column, nxt: Column) -> Column:
    """Signed assembly distance; null across contigs or strands."""
    same = (prev["asm_chrom"] == nxt["asm_chrom"]) & (prev["strand"] == nxt["strand"])
    return F.when(
        same & (prev["strand"] == "+"), nxt["asm_start"] - prev["asm_end"]
    ).when(same, prev["asm_start"] - nxt["asm_end"])


def is_gap(prev: Column, nxt: Column) -> Column:
    """An uncovered reference stretch, or touching blocks that differ in the assembly."""
    changed = (
        (prev["asm_chrom"] != nxt["asm_chrom"])
        | (prev["strand"] != nxt["strand"])
        | (F.coalesce(assembly_gap(prev, nxt), F.lit(0)) != 0)
    )
    return (prev["ref_end"] < nxt["ref_start"]) | (
        (prev["ref_end"] == nxt["ref_start"]) & changed
    )


def event_type(prev: Column, nxt: Column) -> Column:
    gap = assembly_gap(prev, nxt)
    return (
        F.when(prev["asm_chrom"] != nxt["asm_chrom"], "translocation")
        .when(prev["strand"] != nxt["strand"], "inversion")
        .when(gap < 0, "complex")
        .when(gap < nxt["ref_start"] - prev["ref_end"], "deletion")
        .otherwise("insertion")
    )


def gap_record(prev: Column, nxt: Column) -> Column:
    """All result fields of one gap event."""
    plus = prev["strand"] == "+"
    gap = assembly_gap(prev, nxt)
    trailing = F.when(plus, prev["asm_end"]).otherwise(prev["asm_start"])
    return F.struct(
        prev["ref_end"].alias("ref_start"),
        nxt["ref_start"].alias("ref_end"),
        prev["asm_chrom"].alias("asm_chrom"),
        F.when(gap.isNull(), trailing)
        .when(plus, prev["asm_end"])
        .otherwise(nxt["asm_end"])
        .alias("asm_start"),
        F.when(gap.isNull(), trailing)
        .when(plus, nxt["asm_start"])
        .otherwise(prev["asm_start"])
        .alias("asm_end"),
        prev["strand"].alias("strand"),
        F.least(prev["mapq"], nxt["mapq"]).alias("mapq"),
        event_type(prev, nxt).alias("event_type"),
        (nxt["ref_start"] - prev["ref_end"]).alias("ref_gap_size"),
        gap.alias("asm_gap_size"),
    )
