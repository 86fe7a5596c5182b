"""Alignment blocks: PAF text and the JSON lookup form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.sources.lines import FILE_SHIFT, file_column, read_lines, with_line_order

BLOCK_COLUMNS = [
    "sample_id", "hap", "block_seq", "ref_chrom", "ref_start", "ref_end", "asm_chrom", "asm_start",
    "asm_end", "strand", "mapq", "matches", "block_len", "cigar", "tp",
]

# Fixed schema of one item of the JSON lookup form.
JSON_BLOCK = "struct<rs:bigint,re:bigint,ac:string,`as`:bigint,ae:bigint,st:string,mq:int,cg:string,tp:string>"
#: What stands before an item's opening brace, and its fields; the braces of the document itself follow nothing.
JSON_ITEM = r"(?s)^(.*[\[,])\s*\{([^{]*)$"
JSON_CHROM = r'(?s)^(?:.*[{,\s])?"((?:[^"\\]|\\.)*)"\s*:\s*\['


def tag_value(fields: Column, tag: str) -> Column:
    """Value of ``tag:type:value`` after the twelve fixed fields; empty when absent.

    The value keeps its own colons and the last of several wins.
    """
    tags = F.slice(fields, 13, F.greatest(F.size(fields) - 12, F.lit(0)))
    hits = F.filter(tags, lambda x: x.startswith(f"{tag}:") & (F.locate(":", x, len(tag) + 2) > 0))
    return F.coalesce(F.split(F.try_element_at(hits, F.lit(-1)), ":", 3)[2], F.lit(""))


def read_paf(
    spark: SparkSession, paths: str | Sequence[str], sample_id: str = "", hap: str = ""
) -> DataFrame:
    """Alignment blocks of one or more PAF files, plain or gzip, in argument order.

    Comment lines, blank lines and lines of fewer than twelve fields are
    dropped; a bad number is an error.
    """
    lines = read_lines(spark, paths)
    tabs = F.length("value") - F.length(F.replace(F.col("value"), F.lit("\t"), F.lit("")))
    lines = lines.filter(~F.col("value").startswith("#") & (tabs >= 11))
    rows = with_line_order(lines, paths, "block_seq").withColumn("f", F.split("value", "\t"))
    num = lambda i: F.col("f")[i].cast("bigint")
    return rows.select(
        F.lit(sample_id).alias("sample_id"),
        F.lit(hap).alias("hap"),
        "block_seq",
        F.col("f")[5].alias("ref_chrom"), num(7).alias("ref_start"), num(8).alias("ref_end"),
        F.col("f")[0].alias("asm_chrom"), num(2).alias("asm_start"), num(3).alias("asm_end"),
        F.col("f")[4].alias("strand"), F.col("f")[11].cast("int").alias("mapq"),
        num(9).alias("matches"), num(10).alias("block_len"),
        tag_value(F.col("f"), "cg").alias("cigar"), tag_value(F.col("f"), "tp").alias("tp"),
    )


def read_mapping_json(
    spark: SparkSession, path: str, sample_id: str = "", hap: str = ""
) -> DataFrame:
    """Blocks from JSON lookup documents; ``block_seq`` rises with the place in each list.

    A folder of documents is read in order of file name. Documents are cut at
    closing braces while they are read, so a row holds one item and a plain file
    is split over tasks; each item takes the chromosome opened last before it.
    Names that hold braces are an error.
    """
    cut = spark.read.text(path, lineSep="}").select(
        "value", file_column().alias("file_path"), F.col("_metadata.file_block_start").alias("block_start")
    )
    rows = with_line_order(cut, path, "block_seq")
    head, body = F.regexp_extract("value", JSON_ITEM, 1), F.regexp_extract("value", JSON_ITEM, 2)
    before = F.when(body != "", head).otherwise(F.col("value"))
    named = F.concat(F.lit('["'), F.regexp_extract(before, JSON_CHROM, 1), F.lit('"]'))
    opened = F.when(before.rlike(JSON_CHROM), F.from_json(named, "array<string>")[0])
    file = F.shiftright("block_seq", FILE_SHIFT).alias("file_ord")
    names = rows.select(file, F.col("block_seq").alias("__from"), opened.alias("ref_chrom")).where("ref_chrom is not null")
    following = Window.partitionBy("file_ord").orderBy("__from")
    names = names.withColumn("__to", F.lead("__from").over(following))
    item = F.from_json(F.concat(F.lit("{"), body, F.lit("}")), JSON_BLOCK, {"mode": "FAILFAST"})
    items = rows.where(body != "").select(file, "block_seq", item.alias("b"))
    inside = (F.col("block_seq") >= F.col("__from")) & (F.col("__to").isNull() | (F.col("block_seq") < F.col("__to")))
    b = items.join(names, "file_ord").where(inside)
    empty = F.lit("")
    return b.select(
        F.lit(sample_id).alias("sample_id"),
        F.lit(hap).alias("hap"),
        "block_seq",
        "ref_chrom", F.col("b.rs").alias("ref_start"), F.col("b.re").alias("ref_end"),
        F.col("b.ac").alias("asm_chrom"), F.col("b.as").alias("asm_start"),
        F.col("b.ae").alias("asm_end"), F.col("b.st").alias("strand"), F.col("b.mq").alias("mapq"),
        F.lit(None).cast("bigint").alias("matches"), F.lit(None).cast("bigint").alias("block_len"),
        F.coalesce("b.cg", empty).alias("cigar"), F.coalesce("b.tp", empty).alias("tp"),
    )


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet layout written by ``write_blocks``."""
    return spark.read.parquet(path).select(*BLOCK_COLUMNS)
