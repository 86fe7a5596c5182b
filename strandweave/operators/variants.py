"""Choosing and checking structural variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.regions import parse_region_greedy


def largest_per_chrom(variants: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest variant of each chromosome (and of each ``by``); the earlier one on ties."""
    row = F.struct((-F.col("size")).alias("rank"), "var_seq", F.struct(*variants.columns).alias("v"))
    return variants.groupBy(*by, "chrom").agg(F.min(row).alias("m")).select("m.v.*")


def select_variants(variants: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """At most ``k`` large variants spread over chromosomes, for each ``by`` (such as ``sample_id``) on its own.

    First the largest of each chromosome, largest first, then the largest of
    the remaining ones whose ``(chrom, pos)`` was not taken. When there are no
    more than ``k`` variants all are kept in order of size. ``pick_ord`` gives
    the final order.
    """
    by, size_order = list(by), [F.desc("size"), F.asc("var_seq")]
    every = Window.partitionBy(*by)

    def front_of(df: DataFrame, n: int, *order) -> DataFrame:
        """The first ``n`` rows of each ``by``; tasks cut down to ``n`` before anything is moved."""
        if not by:
            return df.orderBy(*order).limit(n)
        return df.withColumn("__rn", F.row_number().over(every.orderBy(*order))).filter(F.col("__rn") <= n).drop("__rn")

    # Only the k largest of the chromosome tops are taken in the first pass.
    first = front_of(largest_per_chrom(variants, by), k, *size_order).select(
        *by, "chrom", F.col("pos").alias("top_pos"), F.col("var_seq").alias("top_seq")
    )
    rows = variants.join(first, [*by, "chrom"], "left").withColumn(
        "pass",
        F.when(F.col("top_seq") == F.col("var_seq"), 0)
        .when(F.col("top_pos") == F.col("pos"), 2)
        .otherwise(1),
    )
    # One row more than k tells whether there was a choice to make.
    front = front_of(rows, k + 1, "pass", *size_order)
    ranked = (
        front.withColumn("n", F.count(F.lit(1)).over(every))
        .withColumn("rn", F.row_number().over(every.orderBy("pass", *size_order)))
        .filter((F.col("n") <= k) | ((F.col("pass") < 2) & (F.col("rn") <= k)))
    )
    by_size = every.orderBy(*size_order)
    by_place = every.orderBy("chrom", "pos", "pass", *size_order)
    return ranked.withColumn(
        "pick_ord",
        F.when(F.col("n") <= k, F.row_number().over(by_size)).otherwise(F.row_number().over(by_place)),
    ).select(*variants.columns, "pick_ord").orderBy(*by, "pick_ord")


def chromosome_count(variants: DataFrame) -> DataFrame:
    return variants.agg(F.countDistinct("chrom").alias("n_chroms"))


def check_variants(variants: DataFrame) -> DataFrame:
    """Per-check number of failing rows of a variant manifest, in one pass."""
    # The manifest's region format and its fields.
    form = r"^[^\s:]+:\d+-\d+$"
    required = ["chrom", "pos", "size", "genotype", "ref_region", "fasta_region",
                "hap1_regions", "hap2_regions"]
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(name).isNull()
    ref, fasta = parse_region_greedy(F.col("ref_region")), parse_region_greedy(F.col("fasta_region"))
    bad_list = lambda c: F.exists(F.col(c), lambda x: ~x.rlike(form))
    good = lambda c: F.coalesce(c, F.lit(False))
    fails = lambda c, name: F.count_if(~good(c)).alias(name)
    return variants.agg(
        F.count(F.lit(1)).alias("n_variants"),
        F.countDistinct("chrom").alias("n_chroms"),
        F.count_if(missing).alias("missing_field"),
        fails(F.col("ref_region").rlike(form) & F.col("fasta_region").rlike(form)
              & ~bad_list("hap1_regions") & ~bad_list("hap2_regions"), "bad_format"),
        fails(F.col("size") > 0, "bad_size"),
        fails(F.col("genotype").contains("|") & F.col("genotype").contains("1"), "bad_genotype"),
        fails((ref["chrom"] == F.col("chrom")) & (ref["start"] == F.col("pos"))
              & (ref["end"] == F.col("pos") + F.col("size")), "bad_ref_region"),
        fails((fasta["chrom"] == F.col("chrom"))
              & (fasta["end"] - fasta["start"] > F.col("size")), "bad_fasta_region"),
    )
