"""Dot plots of reference windows against the haplotypes they map to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.regions import buffered_window, format_region, one_based, parse_region_greedy
from strandweave.operators.intervals import best_cluster, cluster_intervals
from strandweave.operators.kmer_match import dotplot_matches, dotplot_summary
from strandweave.operators.sequences import CHUNK, slice_sequences
from strandweave.plans.mapping import translated_intervals
from strandweave.session import stored
from strandweave.sources.lookup import Lookup

# Fixed value: the three comparisons, first sequence on the horizontal axis.
COMPARISONS = (("ref", "hap1"), ("ref", "hap2"), ("hap1", "hap2"))


def buffered_regions(regions: DataFrame, buffer: float = 1.0, limit: int | None = None) -> DataFrame:
    """The padded windows, and by how much each was trimmed to ``limit``.

    Exploding the one window keeps its arithmetic in one place; otherwise every
    later filter on its bounds would be rewritten to hold all of it.
    """
    window = buffered_window(F.col("start"), F.col("end"), F.lit(float(buffer)), limit)
    padded = regions.select("region_id", "sample_id", "chrom", F.explode(F.array(window)).alias("w"))
    return padded.select(
        "region_id", "sample_id", "chrom", F.col("w.start").alias("start"), F.col("w.end").alias("end"),
        "w.trimmed",
    )


def dotplot_spans(
    regions: DataFrame, blocks: DataFrame | Lookup, buffer: float = 1.0, limit: int | None = None, **options
) -> DataFrame:
    """``region_id, sample_id, side, name, start, end``: what to cut from each genome.

    The buffered window is translated to each haplotype and the cluster covering
    most bases is taken, strands together. Where nothing maps, the region's own
    ``hap1_region`` or ``hap2_region`` text is used if it has one.
    """
    wide = buffered_regions(regions, buffer, limit)
    keys = ["region_id", "sample_id", "hap"]
    pieces = translated_intervals(wide, blocks, **options)
    best = best_cluster(cluster_intervals(pieces, [*keys, "asm_chrom"]), keys)
    mapped = best.select(
        "region_id", "sample_id", F.col("hap").alias("side"), F.col("asm_chrom").alias("name"), "start", "end"
    )
    ref = wide.select("region_id", "sample_id", F.lit("ref").alias("side"), F.col("chrom").alias("name"), "start", "end")
    spans = ref.unionByName(mapped)
    for hap in ("hap1", "hap2"):
        if f"{hap}_region" in regions.columns:
            text = regions.select(
                "region_id", "sample_id", F.lit(hap).alias("side"), parse_region_greedy(F.col(f"{hap}_region")).alias("r")
            ).filter("r.valid")
            spare = text.join(mapped.select("region_id", "side"), ["region_id", "side"], "left_anti")
            spans = spans.unionByName(
                spare.select("region_id", "sample_id", "side", F.col("r.chrom").alias("name"), "r.start", "r.end")
            )
    bounds = one_based(F.col("start"), F.col("end"))
    return spans.withColumn("b", bounds).select(
        "region_id", "sample_id", "side", "name", F.col("b.start").alias("start"), F.col("b.end").alias("end")
    )


def dotplot_sides(spans: DataFrame, chunks: DataFrame, chunk_size: int = CHUNK) -> DataFrame:
    """``region_id, side, bases``, uppercased.

    ``chunks`` holds the genomes under the names ``sample/ref``, ``sample/hap1``
    and ``sample/hap2``. A side without sequence counts as empty text.
    """
    asked = spans.withColumn("genome", F.concat_ws("/", "sample_id", "side"))
    cut = slice_sequences(asked, chunks, ["region_id", "side"], chunk_size)
    return cut.select("region_id", "side", F.upper(F.coalesce("bases", F.lit(""))).alias("bases"))


def dotplot_pairs(sides: DataFrame) -> DataFrame:
    """``pair_id, region_id, comparison, seq1, seq2`` for the three comparisons."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("bases"))).alias(s)
    wide = sides.groupBy("region_id").agg(side("ref"), side("hap1"), side("hap2"))
    own = lambda s: F.coalesce(F.col(s), F.lit(""))
    each = F.explode(F.array(*[
        F.struct(F.lit(f"{a}/{b}").alias("comparison"), own(a).alias("seq1"), own(b).alias("seq2")) for a, b in COMPARISONS
    ]))
    pair = F.concat_ws("|", F.col("region_id").cast("string"), "p.comparison").alias("pair_id")
    return wide.select("region_id", each.alias("p")).select(pair, "region_id", "p.comparison", "p.seq1", "p.seq2")


def dotplot(
    regions: DataFrame, blocks: DataFrame | Lookup, chunks: DataFrame, k: int = 31, buffer: float = 1.0,
    cap: int | None = None, chunk_size: int = CHUNK, **options,
) -> tuple[DataFrame, DataFrame]:
    """``(matches, summary)`` of the three comparisons of every region.

    ``cap`` limits the matches of a pair and ``limit`` the padded window; without
    them nothing is left out. The sides are stored once: matches and summary
    both start from them.
    """
    sides = stored(dotplot_sides(dotplot_spans(regions, blocks, buffer, **options), chunks, chunk_size), "sides")
    pairs = dotplot_pairs(sides).select("pair_id", "seq1", "seq2")
    return dotplot_matches(pairs, k, cap), dotplot_summary(pairs, k, cap)


def region_text(spans: DataFrame) -> DataFrame:
    """The spans as ``name:start-end``."""
    return spans.withColumn("region", format_region(F.col("name"), F.col("start"), F.col("end")))
