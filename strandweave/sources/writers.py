"""Writers. Every writer goes through Spark's committed output; no rows reach the driver."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.regions import format_region
from strandweave.operators.overlap import position_bin
from strandweave.sources.paf import BLOCK_COLUMNS

#: Bases of the reference whose blocks are stored by one task.
STRETCH = 1 << 20
HIT_COLUMNS = ["ref_chrom", "ref_start", "ref_end", "asm_chrom", "asm_start", "asm_end",
               "strand", "mapq", "event_type"]
HIT_ORDER = ["region_id", "sample_id", "hap", "block_start", "block_seq", "kind"]


def sorted_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks by chromosome and start; input order on ties."""
    return blocks.orderBy("ref_chrom", "ref_start", "block_seq")


def write_mapping_bed(blocks: DataFrame, path: str) -> None:
    """Ten tab-separated columns, range-sorted across the part files."""
    sorted_blocks(blocks).select(
        "ref_chrom", "ref_start", "ref_end", "asm_chrom", "asm_start", "asm_end", "strand",
        "mapq", "block_len", "matches",
    ).write.csv(path, sep="\t", header=False, mode="overwrite")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """The lookup layout: Parquet by sample, haplotype and chromosome, sorted by start.

    Partition folders prune by chromosome, and row-group statistics on the
    sorted start prune by position. Rows are dealt by stretch of the reference,
    which spreads a large chromosome over several tasks and files; ranges would
    have to be found by reading all blocks once more.
    """
    keys = ["sample_id", "hap", "ref_chrom"]
    spread = blocks.select(*BLOCK_COLUMNS).repartition(*keys, position_bin(F.col("ref_start"), STRETCH))
    spread.sortWithinPartitions(*keys, "ref_start", "block_seq").write.partitionBy(*keys).mode(
        "overwrite"
    ).parquet(path)


def write_mapping_json(blocks: DataFrame, path: str) -> None:
    """Blocks of one assembly as ``{chrom: [{rs,re,ac,as,ae,st,mq[,cg][,tp]}, ...], ...}``.

    Every part file is a whole document and the parts follow each other in
    position order. Items are built by Spark; Python only adds the brackets
    around them as sorted batches stream by, so no chromosome is gathered.
    """
    some = lambda c, name: F.when(F.col(c) != "", F.col(c)).alias(name)
    item = F.struct(
        F.col("ref_start").alias("rs"), F.col("ref_end").alias("re"), F.col("asm_chrom").alias("ac"),
        F.col("asm_start").alias("as"), F.col("asm_end").alias("ae"), F.col("strand").alias("st"),
        F.col("mapq").alias("mq"), some("cigar", "cg"), some("tp", "tp"),
    )
    place = ["ref_chrom", "ref_start", "block_seq"]

    def document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chrom = None
        for pdf in batches:
            fresh = pdf["ref_chrom"].ne(pdf["ref_chrom"].shift(fill_value=chrom or ""))
            if chrom is None and len(pdf):
                fresh.iloc[0] = True
            opening = pdf["ref_chrom"].map(lambda c: json.dumps(c) + ":[")
            lead = opening.radd("],").where(fresh, ",")
            if chrom is None and len(pdf):
                lead.iloc[0] = "{" + opening.iloc[0]
            if len(pdf):
                chrom = pdf["ref_chrom"].iloc[-1]
            yield pd.DataFrame({"value": lead + pdf["item"]})
        if chrom is not None:
            yield pd.DataFrame({"value": ["]}"]})

    rows = blocks.select(*place, F.to_json(item).alias("item"))
    ordered = rows.repartitionByRange(*place).sortWithinPartitions(*place)
    ordered.mapInPandas(document, "value string").write.mode("overwrite").text(path, compression="gzip")


def write_hits_tsv(hits: DataFrame, path: str) -> None:
    """Nine tab-separated columns with a header, in result order."""
    hits.orderBy(*HIT_ORDER).select(*HIT_COLUMNS).write.csv(path, sep="\t", header=True, mode="overwrite")


def write_tagged_reads(reads: DataFrame, path: str) -> None:
    """Reads with their haplotype, as Parquet sorted by position within each file."""
    reads.repartitionByRange("chrom", "start", "read_seq").sortWithinPartitions("chrom", "start", "read_seq").write.mode(
        "overwrite"
    ).parquet(path)


def write_sam(lines: DataFrame, path: str) -> None:
    """SAM record lines (column ``line``)."""
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def manifest_rows(regions: DataFrame) -> DataFrame:
    """Variants as the manifest writes them: the plain and the padded region text."""
    return regions.select(
        "chrom", "pos", "size", "genotype",
        format_region(F.col("chrom"), F.col("pos"), F.col("pos") + F.col("size")).alias("ref_region"),
        "fasta_region", "hap1_regions", "hap2_regions",
    )


def write_manifest(regions: DataFrame, path: str, description: str = "") -> None:
    """One JSON document ``{description, variants: [...]}``.

    The document holds the few variants ``select_variants`` picked, at most its ``k``.
    """
    v = manifest_rows(regions)
    item = F.struct("chrom", "pos", F.struct(*v.columns).alias("v"))
    doc = v.agg(F.array_sort(F.collect_list(item)).alias("all")).select(
        F.to_json(
            F.struct(
                F.lit(description).alias("description"),
                F.transform("all", lambda x: x["v"]).alias("variants"),
            )
        ).alias("value")
    )
    doc.coalesce(1).write.mode("overwrite").text(path)


def write_fasta(seqs: DataFrame, path: str) -> None:
    """``>name`` and the sequence, one record per row of ``name, bases``."""
    seqs.filter(F.col("bases").isNotNull()).select(
        F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("bases")).alias("value")
    ).write.mode("overwrite").text(path)


def write_fasta_parts(parts: DataFrame, path: str, width: int = 60) -> None:
    """Records of ``ord, name, part_no, bases`` with lines of ``width`` letters, in order of ``ord``.

    Parts follow each other without a break: every part but a record's last has
    a multiple of ``width`` letters. A record lies in one file, and files follow
    in order; its parts stream through the task that writes it, so no row is
    longer than a part.
    """
    lines = F.regexp_replace("bases", f"(.{{{width}}})(?=.)", "$1\n")
    text = F.when(F.col("part_no") == 0, F.concat(F.lit(">"), "name", F.lit("\n"), lines)).otherwise(lines)
    spread = parts.filter(F.length("bases") > 0).select("ord", "name", "part_no", text.alias("value"))
    spread.repartitionByRange("ord", "name").sortWithinPartitions("ord", "name", "part_no").select("value").write.mode("overwrite").text(path)
