"""The corpus pipeline: language ID, near-dedup, suffix-array dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read back as the next one's ``docs``. All but the last
return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import langid, mixing, packing, simhash, suffix_dedup
from strandweave.llm.common import save, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that can have no language: null texts and texts without a letter.

    Where there is no label to learn from, no language can be told; then, too,
    every document with a letter stays.
    """
    labelled = docs.where(~langid.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    langs, matrix = langid.fit(labelled.select("doc_id", "text", "lang"))
    rows = docs.select(F.struct("*").alias("_row"))
    found = langid.predict(rows, langs, matrix, keep=("_row",), inside="_row")
    unknown = (F.col("lang_pred") == langid.UNKNOWN) & (F.col("score") == 0)
    return found.where(~unknown | (F.lit(not langs) & langid.has_letter(F.col("_row.text")))).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id."""
    return simhash.keep_first(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated passages; a document of which nothing is left goes."""
    left = suffix_dedup.remove_passages(docs)
    return left.where("text is null or text <> ''")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizing has no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; what each returns is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = save(docs, name)
    return docs
