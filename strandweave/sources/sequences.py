"""FASTA text and its index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.operators.overlap import position_bin
from strandweave.operators.scan import DEFAULT_BIN, running
from strandweave.operators.sequences import CHUNK
from strandweave.sources.lines import read_lines, with_line_order


def read_fasta(spark: SparkSession, path: str, genome: str = "") -> DataFrame:
    """``genome, name, seq``: one row per record, uppercased; the name ends at a blank.

    A record starts at a ``>`` that begins a line; others belong to its header.
    Long sequences are better read with ``read_fasta_chunks``.
    """
    records = spark.read.text(path, lineSep="\n>").filter(F.btrim("value", F.lit(" \t\r\n")) != "")
    head_body = F.split(F.regexp_replace("value", r"^>", ""), "\n", 2)
    bases = F.upper(F.regexp_replace(F.coalesce(F.get(head_body, F.lit(1)), F.lit("")), r"\s", ""))
    return records.select(
        F.lit(genome).alias("genome"),
        F.regexp_extract(head_body[0], r"^(\S*)", 1).alias("name"),
        bases.alias("seq"),
    )


def read_fasta_chunks(
    spark: SparkSession, path: str, genome: str = "", size: int = CHUNK, bin_width: int = DEFAULT_BIN
) -> DataFrame:
    """``genome, name, chunk, bases``: the records as ``chunk_sequences`` gives them, straight from the lines.

    No row ever holds a sequence. Lines are numbered, each finds its header by a
    running maximum and its place in the record by a running sum over slices of
    the file; a line goes to the one or more chunks that it touches.
    """
    lines = with_line_order(read_lines(spark, path), path, "ord").withColumn("file", F.lit(0))
    header = F.col("value").startswith(">")
    lines = running(lines, ["file"], ["ord"], F.when(header, F.col("ord")), "record", inclusive=True, bin_width=bin_width)
    names = lines.filter(header).select("record", F.regexp_extract("value", r"^>(\S*)", 1).alias("name"))
    body = lines.filter(~header & F.col("record").isNotNull()).select(
        "record", "ord", position_bin(F.col("ord"), bin_width).alias("slice"),
        F.upper(F.regexp_replace("value", r"\s", "")).alias("part"),
    )
    earlier = Window.partitionBy("record").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("record", "slice").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    sums = body.groupBy("record", "slice").agg(F.sum(F.length("part")).alias("n"))
    bases = sums.select("record", "slice", F.coalesce(F.sum("n").over(earlier), none).alias("base"))
    placed = body.join(bases, ["record", "slice"]).select(
        "record", "part", (F.col("base") + F.coalesce(F.sum(F.length("part")).over(inside), none)).alias("at")
    )
    width = F.lit(size).cast("bigint")
    chunk_of = lambda p: ((p - p % width) / width).cast("int")
    last = F.col("at") + F.length("part") - 1
    touched = placed.select("record", "part", "at", F.explode(F.sequence(chunk_of(F.col("at")), chunk_of(last))).alias("chunk"))
    first = F.greatest(F.col("chunk") * width - F.col("at"), none)
    begin = F.greatest(F.col("at") - F.col("chunk") * width, none)
    cut = F.substring("part", (first + 1).cast("int"), (width - begin).cast("int"))
    parts = touched.select("record", "chunk", begin.alias("begin"), cut.alias("cut")).groupBy("record", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "cut"))), lambda x: x["cut"]), "").alias("bases")
    )
    # A header without a sequence has one empty chunk.
    every = names.join(parts, "record", "left")
    return every.select(
        F.lit(genome).alias("genome"), "name", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("bases", F.lit("")).alias("bases")
    )


def read_fai(spark: SparkSession, path: str, genome: str = "") -> DataFrame:
    """``genome, contig_ord, name, length`` in index order; a bad length is an error."""
    lines = read_lines(spark, path).filter(F.size(F.split("value", "\t")) >= 2)
    rows = with_line_order(lines, path, "contig_ord")
    f = F.split("value", "\t")
    return rows.select(
        F.lit(genome).alias("genome"), "contig_ord",
        f[0].alias("name"), f[1].cast("bigint").alias("length"),
    )
