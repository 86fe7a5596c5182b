"""The sample sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Header-driven TSV; every column is kept as text.

    The header is the first line, with or without ``#``; later ``#`` lines and
    empty lines are skipped. Short rows are filled with empty text. A
    ``reads_bam`` ending in ``.cram`` moves to ``reads_cram`` unless the sheet
    has that column. Only the header line reaches the driver.
    """
    lines = spark.read.text(path).select(
        F.rtrim(F.col("value"), F.lit("\r\n")).alias("value"),
        F.monotonically_increasing_id().alias("n"),
    ).filter(F.col("value") != "")
    head = lines.orderBy("n").limit(1).first()
    if head is None:
        raise ValueError(f"no header in {path}")
    names = [c.strip() for c in head["value"].lstrip("#").strip().split("\t")]
    rows = lines.filter((F.col("n") > head["n"]) & ~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    sheet = rows.select(
        *[F.coalesce(F.trim(F.get(f, F.lit(i))), F.lit("")).alias(c) for i, c in enumerate(names)]
    )
    if "reads_bam" in names:
        cram = F.col("reads_bam").endswith(".cram")
        if "reads_cram" not in names:
            sheet = sheet.withColumn("reads_cram", F.when(cram, F.col("reads_bam")).otherwise(F.lit("")))
        sheet = sheet.withColumn("reads_bam", F.when(cram, F.lit("")).otherwise(F.col("reads_bam")))
    return sheet
