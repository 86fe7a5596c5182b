"""Genomic tables derived from the driver's tables.

Each view is one SQL text that Spark and DuckDB both run, with whole-number
arithmetic only, so the queries and their SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.plans.mapping import build_lookup
from strandweave.session import scratch_folder, stored
from strandweave.sources.lookup import Lookup

# Alignment blocks, 0-based half-open.
BLOCKS = """
SELECT 's0' AS sample_id,
  CASE WHEN l_linestatus = 'F' THEN 'hap1' ELSE 'hap2' END AS hap,
  CAST(l_orderkey*8 + l_linenumber AS BIGINT) AS block_seq,
  CONCAT(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(9)), '-',
         CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20)), '-',
         CAST(CAST(ROUND(l_extendedprice*100) AS BIGINT) AS VARCHAR(20))) AS block_id,
  CONCAT('chr', CAST(l_suppkey % 5 + 1 AS VARCHAR(9))) AS ref_chrom,
  CAST(l_orderkey*40 + l_partkey % 37 AS BIGINT) AS ref_start,
  CAST(l_orderkey*40 + l_partkey % 37 + 20 + (l_suppkey*7) % 31 AS BIGINT) AS ref_end,
  CONCAT('ctg', CAST(l_partkey % 3 AS VARCHAR(9))) AS asm_chrom,
  CAST(l_orderkey*40 + l_partkey % 53 AS BIGINT) AS asm_start,
  CAST(l_orderkey*40 + l_partkey % 53 + 20 + (l_suppkey*7) % 31 AS BIGINT) AS asm_end,
  CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand,
  CAST(l_linenumber*10 AS INT) AS mapq,
  CAST(10 + l_partkey % 7 AS BIGINT) AS matches,
  CAST(20 + (l_suppkey*7) % 31 AS BIGINT) AS block_len,
  CONCAT('10M', CAST(1 + l_partkey % 4 AS VARCHAR(9)), 'D', CAST(1 + l_partkey % 4 AS VARCHAR(9)), 'I',
         CAST(9 + (l_suppkey*7) % 31 - l_partkey % 4 AS VARCHAR(9)), 'M') AS cigar,
  'P' AS tp
FROM {lineitem}
"""

# Query windows on the block coordinates, 0-based half-open.
WINDOWS = """
SELECT o_orderkey AS region_id, 's0' AS sample_id,
  CONCAT('chr', CAST(o_custkey % 5 + 1 AS VARCHAR(9))) AS chrom,
  CAST(o_orderkey*40 AS BIGINT) AS ws, CAST(o_orderkey*40 + 100 + o_custkey % 200 AS BIGINT) AS we
FROM {orders}
"""

# Aligned reads, 1-based inclusive.
READS = """
SELECT 's0' AS sample_id, event_id AS read_seq,
  CONCAT('r', CAST(user_id AS VARCHAR(12))) AS name,
  CASE WHEN event_id % 4 = 0 THEN 'ref' WHEN event_id % 4 = 1 THEN 'hap1'
       WHEN event_id % 4 = 2 THEN 'hap2' ELSE 'other' END AS track,
  CONCAT('chr', CAST(event_id % 3 + 1 AS VARCHAR(9))) AS chrom,
  CAST(event_id*10 + (event_id*97) % 5000 + 1 AS BIGINT) AS start_pos,
  CAST(event_id*10 + (event_id*97) % 5000 + 110 + (event_id*31) % 800 AS BIGINT) AS end_pos,
  CAST(CASE WHEN event_id % 7 = 0 THEN 4 ELSE 0 END + (event_id % 2)*16
       + CASE WHEN event_id % 11 = 0 THEN 256 ELSE 0 END AS INT) AS flags,
  CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id % 61 AS INT) END AS mapq,
  CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id % 3 AS INT) END AS hp,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(FLOOR(value*10) AS INT) END AS as_score,
  CONCAT('5S', CAST(20 + event_id % 10 AS VARCHAR(9)), 'M3I', CAST(1 + event_id % 3 AS VARCHAR(9)), 'X',
         CAST(40 + event_id % 30 AS VARCHAR(9)), 'D',
         CAST(49 + (event_id*31) % 800 - event_id % 10 - event_id % 3 - event_id % 30 AS VARCHAR(9)), 'M',
         CASE WHEN event_id % 2 = 0 THEN '7S' ELSE '' END) AS cigar
FROM {events}
"""

# Views onto the reads, 1-based inclusive.
SPANS = """
SELECT o_orderkey AS region_id, 's0' AS sample_id,
  CONCAT('chr', CAST(o_custkey % 3 + 1 AS VARCHAR(9))) AS chrom,
  CAST(o_orderkey*7 + 1 AS BIGINT) AS vs, CAST(o_orderkey*7 + 60 + o_custkey % 300 AS BIGINT) AS ve
FROM {orders}
"""

# Structural variants.
VARIANTS = """
SELECT o_orderkey AS var_seq, CONCAT('chr', CAST(o_custkey % 23 + 1 AS VARCHAR(9))) AS chrom,
  CAST(o_orderkey*100 + o_custkey % 50 AS BIGINT) AS pos,
  CAST(1 + (o_custkey*37 + o_orderkey) % 1500 AS BIGINT) AS size,
  CASE WHEN o_orderstatus = 'O' THEN '0|1' WHEN o_orderstatus = 'F' THEN '1/1' ELSE '0|0' END AS gt
FROM {orders}
"""

# Sequences over A, C, G, T and N. DuckDB replaces all matches only with 'g'.
SEQS = """
SELECT doc_id, TRANSLATE(REGEXP_REPLACE(LOWER(text), '[^a-z]', ''{all}),
  'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAN') AS seq FROM {documents}
"""

_TEXTS = {"blocks": BLOCKS, "windows": WINDOWS, "reads": READS, "spans": SPANS,
          "variants": VARIANTS, "seqs": SEQS}
_TABLES = ("lineitem", "orders", "events", "documents", "customer")


def ctes(*names: str) -> str:
    """``WITH`` clause holding the views, for DuckDB."""
    tables = {t: t for t in _TABLES}
    return "WITH " + ", ".join(
        f"{n} AS ({_TEXTS[n].format(all=chr(44) + chr(32) + repr('g'), **tables)})" for n in names
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = [t for t in _TABLES if f"{{{t}}}" in _TEXTS[name]]
    text = _TEXTS[name].replace("{all}", "")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "blocks")


def is_stored(spark: SparkSession, path: str) -> bool:
    """Whether a finished Parquet folder is there."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file)


_LOOKUPS: dict[tuple[str, str], Lookup] = {}


def lookup(spark: SparkSession, sf_dir: str) -> Lookup:
    """The blocks' stored lookup; an application stores it once per data folder, and again if it has been cleared away."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LOOKUPS or not is_stored(spark, f"{_LOOKUPS[key].path}/layout"):
        buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))  # fewer would make few, large tasks
        _LOOKUPS[key] = build_lookup(blocks(spark, sf_dir), scratch_folder(spark, "lookup"), bin_width=256, buckets=buckets)
    return _LOOKUPS[key]


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "windows").withColumnsRenamed({"ws": "start", "we": "end"})


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "reads").withColumnsRenamed({"start_pos": "start", "end_pos": "end"})


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "spans").withColumnsRenamed({"vs": "start", "ve": "end"})


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with the end a deletion of that size has."""
    return _view(spark, sf_dir, "variants").withColumn("end", F.col("pos") + F.col("size") + 1).withColumnRenamed(
        "gt", "genotype"
    )


def numbered(ordered: DataFrame) -> DataFrame:
    """Adds ``ord``: the place of each row as it stands, from 0.

    Rows are stored with their numbers in their partition, to which the rows of earlier partitions are added.
    """
    kept = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)  # as Spark documents the number
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.shiftleft("_part", 33)).alias("_from"))
    return kept.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*ordered.columns, (F.col("_at") + F.col("_from")).alias("ord"))


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "seqs")
