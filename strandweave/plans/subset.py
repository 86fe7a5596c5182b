"""Cutting a small data set around chosen variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.regions import LAST_COLON, format_region, padded_end, padded_start
from strandweave.operators.overlap import overlap_join, point_join
from strandweave.operators.sequences import CHUNK, slice_parts, slice_sequences
from strandweave.operators.variants import select_variants
from strandweave.plans.mapping import assembly_intervals, map_alignments, region_texts
from strandweave.plans.reads import mapped
from strandweave.sources.lines import read_lines
from strandweave.sources.lookup import Lookup

READ_BIN = 16_384


def padded_regions(variants: DataFrame, padding: int = 50_000) -> DataFrame:
    """Variants with the padded window ``start, end``."""
    return variants.withColumn("start", padded_start(F.col("pos"), padding)).withColumn(
        "end", padded_end(F.col("end"), padding)
    )


def compute_regions(
    variants: DataFrame, blocks: DataFrame | Lookup, sample_id: str | None = None, padding: int = 50_000, **options
) -> DataFrame:
    """Variants with ``fasta_region`` and the merged assembly regions of both haplotypes.

    Variants of many samples carry a ``sample_id``; ``var_seq`` is unique in a
    sample. Without that column all belong to ``sample_id``.
    """
    many = sample_id is None
    asked = padded_regions(variants, padding).withColumn("region_id", F.col("var_seq"))
    asked = asked if many else asked.withColumn("sample_id", F.lit(sample_id))
    hits = map_alignments(asked, blocks, **options)
    key = ["sample_id", "region_id"]
    side = lambda h: region_texts(F.col("hap") == h).alias(f"{h}_regions")
    wide = assembly_intervals(hits, [*key, "hap"], ["region_id"]).groupBy(*key).agg(side("hap1"), side("hap2"))
    nothing = F.array().cast("array<string>")
    out = asked.join(wide, key, "left")
    return out.select(
        *variants.columns,
        format_region(F.col("chrom"), F.col("start"), out["end"]).alias("fasta_region"),
        F.coalesce("hap1_regions", nothing).alias("hap1_regions"),
        F.coalesce("hap2_regions", nothing).alias("hap2_regions"),
    )


def variant_manifest(
    variants: DataFrame, blocks: DataFrame | Lookup, sample_id: str | None = None, k: int = 10, padding: int = 50_000, **options
) -> DataFrame:
    """The chosen variants with their regions, ready for the manifest; ``k`` of each sample if they carry a ``sample_id``."""
    chosen = select_variants(variants, k, ["sample_id"] if sample_id is None else [])
    return compute_regions(chosen, blocks, sample_id, padding, **options)


def subset_reads(regions: DataFrame, reads: DataFrame, bin_width: int = READ_BIN) -> DataFrame:
    """Records of the aligned reads in the regions, moved to contigs named after the regions.

    ``regions(region_ord, chrom, start, end)`` and reads with their SAM
    ``line``; if both have a ``sample_id``, it is part of the key and of the
    result. A record found in several regions is kept for the first. Mates on
    other contigs are blanked, and supplementary entries are moved to the first
    region holding them or dropped. Returns ``region_ord, read_seq, line``.

    Records are chosen by name, flags, place and ``read_seq``, which together
    are unique. Only these, the mate and the ``SA`` tags travel; the line itself
    is fetched once, for the records that are kept.
    """
    sample = ["sample_id"] if "sample_id" in regions.columns and "sample_id" in reads.columns else []
    named = regions.withColumn("text", format_region(F.col("chrom"), F.col("start"), F.col("end")))
    asked = named.select(
        *sample, "region_ord", "chrom", F.col("text").alias("region"),
        F.col("start").alias("r_start"), F.col("end").alias("r_end"),
    )
    f = F.split("line", "\t")
    marked = F.transform(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), lambda t, i: F.struct(i.alias("tag_no"), t.alias("tag")))
    slim = mapped(reads).select(
        *sample, "chrom", "start", "end", "name", "flags", "read_seq",
        f[6].alias("mate"), f[7].alias("mate_pos"), F.filter(marked, lambda t: t["tag"].startswith("SA:Z:")).alias("tags"),
    )
    found = overlap_join(asked, slim, [*sample, "chrom"], ("r_start", "r_end"), ("start", "end"), bin_width, closed=True)
    record = [*sample, "name", "flags", "chrom", "start"]
    first = F.min(F.struct("region_ord", "read_seq", "region", "r_start", "mate", "mate_pos", "tags")).alias("m")
    kept = found.groupBy(*record).agg(first).select(*record, "m.*")

    shift = lambda p: F.greatest(F.lit(1).cast("bigint"), p - F.col("r_start") + 1)
    mate, mate_pos = F.col("mate"), F.col("mate_pos").cast("bigint")
    own = (mate == "=") | (mate == F.col("chrom"))
    # A mate contig can only be a region name if it reads like one. All other
    # rows get one of many keys that match nothing, so none of them is crowded.
    ask = ~own & (mate != "*") & mate.rlike(LAST_COLON)
    kept = kept.withColumn(
        "__mate", F.when(ask, mate).otherwise(F.concat(F.lit("\t"), F.pmod("read_seq", F.lit(997)).cast("string")))
    )
    known = named.select(*sample, F.col("text").alias("__mate"), F.lit(True).alias("__known")).distinct()
    kept = kept.join(known, [*sample, "__mate"], "left")
    moved_mate = F.when(mate == F.col("chrom"), F.col("region")).when(
        own | (mate == "*") | F.col("__known"), mate
    ).otherwise(F.lit("*"))
    moved_pos = (
        F.when(own, F.when(mate_pos > 0, shift(mate_pos).cast("string")).otherwise(F.col("mate_pos")))
        .when((mate == "*") | F.col("__known"), F.col("mate_pos"))
        .otherwise(F.lit("0"))
    )
    key = [*record, "read_seq"]
    kept = kept.select(*key, "region_ord", "region", "r_start", "tags", moved_mate.alias("new_mate"), moved_pos.alias("new_pos"))
    chosen = kept.drop("tags").join(remap_supplementary(kept, named, key, sample), key, "left")
    whole = mapped(reads).select(*key, "line").join(chosen, key).withColumn("f", f)
    g = F.col("f")
    new_tags = F.transform(
        F.slice(g, 12, F.greatest(F.size(g) - 11, F.lit(0))),
        lambda t, i: F.when(t.startswith("SA:Z:"), F.element_at("sa", i)).otherwise(t),
    )
    head = F.array(
        g[0], g[1], F.col("region"), shift(g[3].cast("bigint")).cast("string"), g[4], g[5],
        F.col("new_mate"), F.col("new_pos"), g[8], g[9], g[10],
    )
    return whole.select(*sample, "region_ord", "read_seq", F.array_join(F.concat(head, new_tags), "\t").alias("line"))


def remap_supplementary(
    records: DataFrame, regions: DataFrame, key: Sequence[str], sample: Sequence[str] = (), bin_width: int = READ_BIN
) -> DataFrame:
    """``key, sa``: a map from tag place to the moved ``SA:Z:`` tag.

    ``records`` hold ``tags``, a list of ``tag_no, tag``. Each entry
    ``contig,pos,...`` goes to the first region holding its position. Entries
    outside every region, or of fewer than six parts, are dropped; a tag left
    without entries becomes ``SA:Z:*``.
    """
    key, sample = list(key), list(sample)
    tags = records.select(*key, F.explode("tags").alias("t")).select(*key, "t.tag_no", "t.tag")
    body = F.split(F.substring("tag", F.lit(6), F.length("tag")), ";")
    entries = tags.select(*key, "tag_no", F.posexplode(body).alias("entry_no", "entry")).withColumn(
        "p", F.split("entry", ",")
    ).filter(F.size("p") >= 6)
    points = entries.withColumn("sa_chrom", F.col("p")[0]).withColumn("sa_pos", F.col("p")[1].cast("bigint"))
    targets = regions.select(
        *sample, F.col("chrom").alias("sa_chrom"), F.col("region_ord").alias("t_ord"), F.col("text").alias("t_name"),
        F.col("start").alias("t_start"), (F.col("end") + 1).alias("t_end"),
    )
    hit = point_join(points, targets, [*sample, "sa_chrom"], "sa_pos", ("t_start", "t_end"), bin_width)
    entry_key = [*key, "tag_no", "entry_no"]
    won = hit.groupBy(*entry_key).agg(F.min(F.struct("t_ord", "t_name", "t_start", "sa_pos", "p")).alias("w"))
    pos = F.greatest(F.lit(1).cast("bigint"), F.col("w.sa_pos") - F.col("w.t_start") + 1)
    text = F.concat_ws(
        ",", F.col("w.t_name"), pos.cast("string"), F.slice("w.p", F.lit(3), F.size("w.p"))
    )
    joined = won.select(*entry_key, text.alias("entry")).groupBy(*key, "tag_no").agg(
        F.concat(
            F.lit("SA:Z:"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("entry_no", "entry"))), lambda x: x["entry"]), ";"
            ),
            F.lit(";"),
        ).alias("moved")
    )
    full = tags.select(*key, "tag_no").join(joined, [*key, "tag_no"], "left").withColumn(
        "moved", F.coalesce("moved", F.lit("SA:Z:*"))
    )
    return full.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct("tag_no", "moved"))).alias("sa")
    )


def subset_header(spark: SparkSession, sam_paths: str | Sequence[str], regions: DataFrame) -> DataFrame:
    """Header lines of the subset: the source's HD, RG and PG lines and one SQ line per region."""
    lines = read_lines(spark, sam_paths).filter(F.col("value").rlike(r"^@(HD|RG|PG)\b")).distinct()
    rank = F.when(F.col("value").startswith("@HD"), 0).when(F.col("value").startswith("@RG"), 2).otherwise(3)
    kept = lines.select(rank.alias("part"), F.lit(0).cast("bigint").alias("ord"), F.col("value").alias("line"))
    text = format_region(F.col("chrom"), F.col("start"), F.col("end"))
    sq = regions.select(
        F.lit(1).alias("part"), F.col("region_ord").cast("bigint").alias("ord"),
        F.concat(
            F.lit("@SQ\tSN:"), text, F.lit("\tLN:"), (F.col("end") - F.col("start") + 1).cast("string")
        ).alias("line"),
    )
    return kept.unionByName(sq).orderBy("part", "ord", "line")


def distinct_regions(texts: DataFrame) -> DataFrame:
    """``region, ord``: each region text once, at its first place."""
    return texts.groupBy("region").agg(F.min("ord").alias("ord"))


def _once(regions: DataFrame) -> DataFrame:
    """Each distinct region, named by its text, at its first place."""
    text = format_region(F.col("chrom"), F.col("start"), F.col("end"))
    return regions.groupBy("genome", "chrom", "start", "end").agg(F.min("ord").alias("ord")).withColumn(
        "region", text
    ).withColumnRenamed("chrom", "name")


def subset_sequences(regions: DataFrame, chunks: DataFrame, chunk_size: int = CHUNK) -> DataFrame:
    """``ord, name, bases``: the letters of each distinct region, named by its text.

    ``regions(ord, genome, chrom, start, end)``; the result is ready for
    ``write_fasta``. A row holds its region; for long ones use ``subset_parts``.
    """
    cut = slice_sequences(_once(regions), chunks, ["genome", "region"], chunk_size)
    return cut.select("genome", "ord", F.col("region").alias("name"), "bases")


def subset_parts(regions: DataFrame, chunks: DataFrame, chunk_size: int = CHUNK, part: int = CHUNK) -> DataFrame:
    """``genome, ord, name, part_no, bases``: ``subset_sequences`` in parts of at most ``part`` letters, for ``write_fasta_parts``."""
    once = _once(regions)
    cut = slice_parts(once, chunks, ["genome", "region", "ord"], chunk_size, part)
    return cut.select("genome", "ord", F.col("region").alias("name"), "part_no", "bases")
