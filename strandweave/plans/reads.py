"""Reads in windows: coverage, comparison, pileups and region panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import sam
from strandweave.functions.regions import parse_region_viewer
from strandweave.operators.coverage import binned_coverage, compare_read_sets, read_stats
from strandweave.operators.intervals import bounding_region
from strandweave.operators.lanes import pack_lanes, pack_lanes_by_haplotype
from strandweave.operators.overlap import overlap_join
from strandweave.plans.mapping import map_alignments
from strandweave.sources.alignments import PANEL_TRACKS

READ_BIN = 16_384


def reads_in_regions(
    regions: DataFrame, reads: DataFrame, bin_width: int = READ_BIN,
    keys: Sequence[str] = ("sample_id", "chrom"),
) -> DataFrame:
    """Aligned reads sharing a base with a region; both are 1-based inclusive."""
    asked = regions.select(
        "region_id", *keys, F.col("start").alias("view_start"), F.col("end").alias("view_end")
    )
    return overlap_join(
        asked, mapped(reads), list(keys), ("view_start", "view_end"), ("start", "end"), bin_width, closed=True
    )


def mapped(reads: DataFrame) -> DataFrame:
    """Aligned reads; where there are no flags, all reads are."""
    return reads.filter(sam.is_mapped(F.col("flags"))) if "flags" in reads.columns else reads


def coverage(regions: DataFrame, reads: DataFrame, num_bins: int, bin_width: int = READ_BIN) -> DataFrame:
    """Binned depth of each region, in total and per haplotype."""
    views = regions.select(
        "region_id", F.col("start").alias("view_start"), F.col("end").alias("view_end")
    )
    seen = reads_in_regions(regions, mapped(reads).select("sample_id", "chrom", "start", "end", "hp"), bin_width)
    return binned_coverage(views, seen, num_bins)


def compare_reads(regions: DataFrame, reads: DataFrame, bin_width: int = READ_BIN) -> DataFrame:
    """Read-name overlap of the ref, hap1 and hap2 tracks of each region; zeros where there are no reads."""
    slim = mapped(reads).select("sample_id", "chrom", "start", "end", "track", "name")
    found = compare_read_sets(reads_in_regions(regions, slim, bin_width))
    return with_every(regions.select("region_id"), found)


def region_stats(regions: DataFrame, reads: DataFrame, bin_width: int = READ_BIN) -> DataFrame:
    """Read statistics of each region; zeros where there are no reads."""
    slim = reads.select("sample_id", "chrom", "start", "end", "flags", "mapq")
    return with_every(regions.select("region_id"), read_stats(reads_in_regions(regions, slim, bin_width)))


def with_every(asked: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each asked key: its counts, or zeros; an average without a count stays null."""
    out = asked.join(found, asked.columns, "left")
    counts = [c for c in found.columns if c not in asked.columns and not c.startswith("avg_")]
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counts})


def pileup(
    regions: DataFrame, reads: DataFrame, by_haplotype: bool = False, bin_width: int = READ_BIN
) -> DataFrame:
    """``region_id, track, read_seq, lane`` for the reads of each region and track."""
    slim = mapped(reads).select("sample_id", "chrom", "start", "end", "track", "read_seq", "hp")
    seen = reads_in_regions(regions, slim, bin_width)
    pack = pack_lanes_by_haplotype if by_haplotype else pack_lanes
    return pack(seen, ["region_id", "track"])


def panel_regions(regions: DataFrame, blocks: DataFrame, **options) -> DataFrame:
    """``region_id, sample_id, panel, chrom, start, end``: ref, hap1 and hap2 of each region.

    A haplotype's place is the first one the region lists, else the bounding
    interval of its aligned bases on the first contig by name; without either
    the panel is left out.
    """
    listed = regions.select(
        "region_id", "sample_id",
        F.explode(
            F.array(
                F.struct(F.lit("hap1").alias("hap"), F.get("hap1_regions", F.lit(0)).alias("text")),
                F.struct(F.lit("hap2").alias("hap"), F.get("hap2_regions", F.lit(0)).alias("text")),
            )
        ).alias("h"),
    ).select("region_id", "sample_id", "h.hap", parse_region_viewer(F.col("h.text")).alias("r"))
    open_haps = listed.filter(~F.col("r.valid"))
    asked = regions.join(open_haps.select("region_id").distinct(), "region_id", "left_semi")
    boxes = bounding_region(map_alignments(asked, blocks, **options), ["region_id", "sample_id", "hap"])
    mapped = boxes.join(open_haps.select("region_id", "hap"), ["region_id", "hap"], "left_semi").select(
        "region_id", "sample_id", F.col("hap").alias("panel"), F.col("asm_chrom").alias("chrom"), "start", "end"
    )
    given = listed.filter("r.valid").select(
        "region_id", "sample_id", F.col("hap").alias("panel"), "r.chrom", "r.start", "r.end"
    )
    ref = regions.select("region_id", "sample_id", F.lit("ref").alias("panel"), "chrom", "start", "end")
    return ref.unionByName(given).unionByName(mapped)


def panel_tracks(panels: DataFrame) -> DataFrame:
    """Each panel once per track it shows, with the view bounds."""
    tracks = F.create_map(
        *[x for p, ts in PANEL_TRACKS.items() for x in (F.lit(p), F.array(*[F.lit(t) for t in ts]))]
    )
    return panels.select(
        "region_id", "sample_id", "panel", "chrom", F.col("start").alias("view_start"),
        F.col("end").alias("view_end"), F.explode(tracks[F.col("panel")]).alias("track"),
    )


def panel_reads(panels: DataFrame, reads: DataFrame, bin_width: int = READ_BIN) -> DataFrame:
    """Aligned reads of the three tracks of each panel, with ``panel`` and the view bounds."""
    return overlap_join(
        panel_tracks(panels), mapped(reads), ["sample_id", "chrom", "track"], ("view_start", "view_end"), ("start", "end"),
        bin_width, closed=True,
    )


def region_panel(regions: DataFrame, blocks: DataFrame, reads: DataFrame, **options) -> DataFrame:
    """Read statistics of every track of every panel of every region; zeros where there are no reads."""
    panels = panel_regions(regions, blocks, **options)
    slim = reads.select("sample_id", "chrom", "track", "start", "end", "flags", "mapq")
    key = ["region_id", "panel", "track"]
    return with_every(panel_tracks(panels).select(*key), read_stats(panel_reads(panels, slim), key))
