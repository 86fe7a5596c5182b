"""Regions of interest: VCF calls and JSON manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import sam
from strandweave.functions.regions import LAST_COLON, format_region, region_label
from strandweave.sources.lines import read_lines, with_line_order

REGION_SCHEMA = (
    "var_seq long, label string, chrom string, start long, end long, ref_region string, "
    "fasta_region string, hap1_regions array<string>, hap2_regions array<string>, "
    "genotype string, size long"
)
MANIFEST_SCHEMA = (
    "description string, variants array<struct<chrom:string,pos:bigint,size:bigint,"
    "genotype:string,ref_region:string,fasta_region:string,"
    "hap1_regions:array<string>,hap2_regions:array<string>>>"
)


def _vcf_fields(spark: SparkSession, paths: str | Sequence[str], least: int) -> DataFrame:
    lines = read_lines(spark, paths)
    f = F.split("value", "\t")
    lines = lines.filter(~F.col("value").startswith("#") & (F.size(f) >= least))
    return with_line_order(lines, paths, "var_seq").select("var_seq", f.alias("f"))


def read_vcf_deletions(
    spark: SparkSession, paths: str | Sequence[str], min_size: int = 1000
) -> DataFrame:
    """Deletions carried by the first sample: ``var_seq, chrom, pos, end, size, genotype``.

    Largest first; ``var_seq`` is the line order and breaks ties.
    """
    f = F.col("f")
    ref_len, alt_len = F.length(f[3]).cast("bigint"), F.length(f[4]).cast("bigint")
    pos, gt = f[1].cast("bigint"), F.split(f[9], ":")[0]
    rows = _vcf_fields(spark, paths, 10)
    kept = rows.filter((ref_len > alt_len) & (ref_len - alt_len >= min_size) & gt.contains("1"))
    return kept.select(
        "var_seq", f[0].alias("chrom"), pos.alias("pos"), (pos + ref_len).alias("end"),
        (ref_len - alt_len).alias("size"), gt.alias("genotype"),
    ).orderBy(F.desc("size"), "var_seq")


def read_vcf_regions(
    spark: SparkSession, paths: str | Sequence[str], min_size: int = 500
) -> DataFrame:
    """Structural variants of any kind as regions.

    The size is the first ``SVLEN`` that is a number, else the difference of
    the allele lengths.
    """
    f = F.col("f")
    noted = F.get(
        F.filter(
            F.transform(
                F.filter(F.split(f[7], ";"), lambda x: x.startswith("SVLEN=")),
                lambda x: F.substring(x, F.lit(7), F.length(x)).try_cast("bigint"),
            ),
            lambda v: v.isNotNull(),
        ),
        F.lit(0),
    )
    alleles = F.abs(F.length(f[3]) - F.length(f[4])).cast("bigint")
    rows = (
        _vcf_fields(spark, paths, 8)
        .withColumn("size", F.coalesce(F.nullif(F.abs(noted), F.lit(0).cast("bigint")), alleles))
        .withColumn("start", f[1].try_cast("bigint"))
        .filter((F.col("size") >= min_size) & F.col("start").isNotNull())
        .withColumn("end", F.col("start") + F.col("size"))
        .withColumn("chrom", f[0])
        .withColumn("genotype", F.when(F.size(f) >= 10, sam.genotype(F.get(f, F.lit(9)))).otherwise(F.lit("")))
    )
    place = (F.col("chrom"), F.col("start"), F.col("end"))
    nothing = F.array().cast("array<string>")
    return rows.select(
        "var_seq", region_label(*place, F.col("size"), F.col("genotype")).alias("label"),
        "chrom", "start", "end", format_region(*place).alias("ref_region"),
        F.lit(None).cast("string").alias("fasta_region"),
        nothing.alias("hap1_regions"), nothing.alias("hap2_regions"), "genotype", "size",
    )


def read_manifest_variants(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The variants of a manifest as they are written, in list order.

    With ``multi_line=False`` each line is a manifest, so many can be split and scanned.
    """
    doc = spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=multi_line)
    v = doc.select(F.posexplode("variants").alias("var_seq", "v"))
    return v.select(F.col("var_seq").cast("bigint").alias("var_seq"), "v.*")


def read_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Manifest variants as regions: ``pos .. pos + size``, else the stored region text."""
    v = read_manifest_variants(spark, path, multi_line)
    text_start = F.regexp_extract("ref_region", LAST_COLON, 2).try_cast("bigint")
    text_end = F.regexp_extract("ref_region", LAST_COLON, 3).try_cast("bigint")
    none = F.lit(0).cast("bigint")
    rows = v.withColumn(
        "start", F.coalesce("pos", text_start, none)
    ).withColumn(
        "end", F.when(F.col("pos").isNotNull(), F.col("pos") + F.coalesce("size", none))
        .otherwise(F.coalesce(text_end, F.col("start") + F.coalesce("size", none)))
    )
    rows = rows.withColumn("size", F.coalesce("size", F.col("end") - F.col("start"))).withColumn("genotype", F.coalesce("genotype", F.lit("?")))
    place = (F.col("chrom"), F.col("start"), F.col("end"))
    nothing = F.array().cast("array<string>")
    blank = F.lit("")
    return rows.select(
        "var_seq", region_label(*place, F.col("size"), F.col("genotype")).alias("label"),
        "chrom", "start", "end", format_region(*place).alias("ref_region"),
        F.coalesce(F.nullif("fasta_region", blank), F.nullif("ref_region", blank)).alias("fasta_region"),
        F.coalesce("hap1_regions", nothing).alias("hap1_regions"),
        F.coalesce("hap2_regions", nothing).alias("hap2_regions"),
        "genotype", "size",
    )


def read_regions(spark: SparkSession, path: str | None) -> DataFrame:
    """Regions by file extension; anything else, or a missing file, is an empty table."""
    reader = None
    if path and path.endswith(".json"):
        reader = read_manifest
    elif path and path.endswith((".vcf", ".vcf.gz")):
        reader = read_vcf_regions
    if reader is not None and _exists(spark, path):
        return reader(spark, path)
    return spark.createDataFrame([], REGION_SCHEMA)


def _exists(spark: SparkSession, path: str) -> bool:
    missing = spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
    try:
        return bool(missing.load(path).inputFiles())
    except Exception as error:  # the path is not there
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
