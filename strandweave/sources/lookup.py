"""The stored lookup: blocks with the gap events before them, and the CIGAR entries of long blocks.

Blocks are dealt by stretch of reference bases, once: the rows of a stretch get
their gaps and their places where they lie, and are stored there. Windows dealt
alike meet them without moving a stored row, and few windows read their
chromosomes only. CIGAR text is not stored: a block knows where it lies as a
whole and, if its CIGAR is short, holds its operations. Of longer CIGARs every 64
operations are an entry of a second table, dealt by position bin, with the bases
before it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import events as E
from strandweave.functions.cigar_arrays import STEP, cigar_index
from strandweave.operators.overlap import position_bin
from strandweave.operators.quality_gaps import FLANK, KEYS, RUN_ROWS, passed_stretches
from strandweave.session import stored

BIN = 65_536
BUCKETS = 64
#: Bases of a stretch, where bins are narrower.
STRETCH = 16_384
#: Tasks that write one bucket.
SPREAD = 4
KINDS = ("blocks", "ops")
_DEALT = {"blocks": "cell", "ops": "bin"}
_SORT = {"blocks": ["sample_id", "stretch", "ref_start"], "ops": ["sample_id", "bin", "block_no"]}
_INNER = ["cell", "stretch", "upto", "sizes", "codes", "gaps"]


@dataclass
class Lookup:
    """An opened lookup. ``blocks, gaps, ops`` are what it holds by bin; rows of ``blocks`` with ``bin = first_bin`` are the blocks themselves."""

    spark: SparkSession
    path: str
    bin_width: int
    buckets: int
    stretch: int
    has_long: bool

    def table(self, kind: str) -> DataFrame:
        return self.spark.table(_name(self.path, kind))

    @property
    def blocks(self) -> DataFrame:
        here = in_bins(self.table("blocks"), "ref_start", "ref_end", self.bin_width)
        return here.where(position_bin(F.col("bin") * self.bin_width, self.stretch) == F.col("stretch")).drop(*_INNER)

    @property
    def gaps(self) -> DataFrame:
        rows = self.table("blocks").select(*KEYS, "block_seq", *FLANK, F.explode("gaps").alias("p"))
        return rows.select(
            *KEYS, "p.over", "p.upto", F.col("ref_start").alias("block_start"), "block_seq", E.gap_record(F.col("p"), following()).alias("g")
        ).select(*KEYS, "over", "upto", "block_start", "block_seq", "g.*").withColumn("bin", position_bin(F.col("ref_start") - 1, self.bin_width))

    @property
    def ops(self) -> DataFrame:
        kept = ["sample_id", "hap", "ref_chrom", "block_no", "entry_start", "entry_end", "asm", "sizes", "codes"]
        rows = self.table("blocks").where((F.col("upto") > 0) & (F.col("stretch") == position_bin(F.col("ref_start"), self.stretch)))
        rows = rows.withColumns({"entry_start": F.col("ref_start"), "entry_end": F.col("ref_start") + F.col("upto"), "asm": F.lit(0).cast("bigint")})
        short = in_bins(rows.select(*kept), "entry_start", "entry_end", self.bin_width).drop("first_bin")
        return short.unionByName(self.table("ops").select(*kept, "bin"))

    def dealt(self, df: DataFrame) -> DataFrame:
        """``df`` dealt by its ``bin`` as the entries of long CIGARs are, so that joining them moves nothing else."""
        return df.repartition(self.buckets, "bin")

    def meet(self, windows: DataFrame, rows: DataFrame) -> DataFrame:
        """Each of ``windows(sample_id, ref_chrom, ws, we, ...)`` beside the blocks among ``rows`` that it holds a base of, or an empty one's place.

        ``rows`` are some of the stored blocks, with ``cell`` and ``stretch``. A
        pair meets in the first stretch of both. Rows of a stretch lie in one
        bucket, so only windows are moved.
        """
        asked = in_bins(windows, "ws", "we", self.stretch).withColumnsRenamed(
            {"sample_id": "_sample", "ref_chrom": "_chrom", "bin": "_stretch", "first_bin": "_first"})
        asked = asked.withColumn("_cell", _cell("_sample", "_chrom", "_stretch")).repartition(self.buckets, "_cell")
        # Spark's default leaves rows in their buckets only if no other columns are compared by "=".
        hidden = self.spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", "true") == "true"
        same = lambda a, b: (F.col(a) <= F.col(b)) & (F.col(a) >= F.col(b)) if hidden else F.col(a) == F.col(b)
        first = position_bin(F.col("ref_start"), self.stretch)
        pairs = asked.join(rows, [
            F.col("_cell") == F.col("cell"), F.col("ref_start") < F.col("we"), F.greatest("ref_end", F.col("ref_start") + 1) > F.col("ws"),
            F.col("stretch") == F.greatest("_first", first), same("_stretch", "stretch"), same("_sample", "sample_id"), same("_chrom", "ref_chrom"),
        ])
        return pairs.drop("_sample", "_chrom", "_stretch", "_first", "_cell", "cell", "stretch")

    def forget(self) -> None:
        """Takes the tables out of the catalog; the files stay."""
        for kind in KINDS:
            self.spark.sql(f"DROP TABLE IF EXISTS {_name(self.path, kind)}")

def _name(path: str, kind: str) -> str:
    return f"lookup_{hashlib.md5(path.rstrip('/').encode()).hexdigest()}_{kind}"


def _cell(sample: str, chrom: str, stretch: str) -> Column:
    """One number for a stretch of a sample's chromosome, by which rows are dealt; others may share it."""
    return F.xxhash64(sample, chrom, stretch)


def following() -> dict[str, Column]:
    """The fields of the block that a row holds, as the one behind a gap."""
    return {c: F.col(c) for c in FLANK}


def in_bins(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row per bin that ``[start, end)`` touches, with ``bin`` and ``first_bin``; empty intervals have none."""
    solid = df.where((F.col(end) > F.col(start)) & (F.col(end) > 0)).withColumn("first_bin", position_bin(F.col(start), width))
    return solid.withColumn("bin", F.explode(F.sequence("first_bin", position_bin(F.col(end) - 1, width))))


def write_lookup(blocks: DataFrame, path: str, bin_width: int = BIN, buckets: int = BUCKETS, run_rows: int = RUN_ROWS) -> Lookup:
    """Stores both tables under ``path``.

    ``blocks`` are read three times and must be the same each time: for long
    CIGARs, for the farthest blocks of each stretch, and to be dealt. A stretch
    has at most ``run_rows`` and ``STRETCH`` bases, but one bin at least. Choose
    ``bin_width`` near the length of windows and blocks, and ``buckets`` so that
    a bucket of a chromosome is a file of some hundred megabytes and there are
    no fewer than ``spark.sql.shuffle.partitions``.
    """
    spark = blocks.sparkSession
    stretch = max(1, min(run_rows, STRETCH) // bin_width) * bin_width
    plain = [c for c in blocks.columns if c != "cigar"]
    text = F.coalesce("cigar", F.lit(""))
    is_long = F.length(text) > 2 * STEP  # fewer letters hold one entry at most
    numbered = blocks.where(is_long).withColumn("block_no", F.monotonically_increasing_id())
    numbered = stored(numbered.withColumn("ix", cigar_index(F.col("cigar"), F.col("ref_end") - F.col("ref_start"))), "numbered")
    has_long = not numbered.isEmpty()
    rows = blocks.where(~is_long).withColumn("cigar", text).withColumn("block_no", -1 - F.monotonically_increasing_id())
    if has_long:
        known = numbered.select(*plain, "block_no", "ix.n_ops", "ix.whole_lo", "ix.whole_hi", "ix.asm_total")
        rows = rows.unionByName(known, allowMissingColumns=True)
    else:
        rows = rows.withColumns({c: F.lit(None).cast("bigint") for c in ("n_ops", "whole_lo", "whole_hi", "asm_total")})
    last = F.greatest(position_bin(F.col("ref_start"), stretch), position_bin(F.col("ref_end") - 1, stretch))
    rows = rows.where("ref_start is not null and ref_end is not null")
    rows = rows.withColumn("stretch", F.explode(F.sequence(position_bin(F.col("ref_start"), stretch), last)))
    rows = passed_stretches(rows, blocks, stretch, _cell("sample_id", "ref_chrom", "stretch"), SPREAD * buckets)
    entries = numbered.select("sample_id", "hap", "ref_chrom", "block_no", "ref_start", F.explode("ix.entries").alias("e")).select(
        "sample_id", "hap", "ref_chrom", "block_no", (F.col("ref_start") + F.col("e.at")).alias("entry_start"),
        (F.col("ref_start") + F.col("e.upto")).alias("entry_end"), F.col("e.asm").alias("asm"), "e.sizes", "e.codes",
    )
    tables = {
        "blocks": rows.withColumn("gaps", F.filter("gaps", lambda p: E.is_gap(p, following()))),
        "ops": in_bins(entries, "entry_start", "entry_end", bin_width).drop("first_bin").repartition(buckets, "bin"),
    }
    for kind, df in tables.items():
        spark.sql(f"DROP TABLE IF EXISTS {_name(path, kind)}")
        writer = df.write.mode("overwrite").option("path", f"{path}/{kind}").option("compression", "zstd")
        writer.partitionBy("ref_chrom").bucketBy(buckets, _DEALT[kind]).sortBy(*_SORT[kind]).saveAsTable(_name(path, kind))
    layout = [(kind, spark.table(_name(path, kind)).schema.simpleString()[7:-1], bin_width, buckets, stretch, has_long) for kind in KINDS]
    kinds = "kind string, columns string, bin_width long, buckets int, stretch long, has_long boolean"
    spark.createDataFrame(layout, kinds).coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    return open_lookup(spark, path)


def open_lookup(spark: SparkSession, path: str) -> Lookup:
    """The lookup stored under ``path``; its tables are entered in the catalog if they are not there."""
    rows = {r.kind: r for r in spark.read.parquet(f"{path}/layout").collect()}  # one row per table
    for kind in KINDS:
        if not spark.catalog.tableExists(_name(path, kind)):
            columns = ", ".join(f"`{n}` {t}" for n, t in (c.split(":", 1) for c in _top_level(rows[kind].columns)))
            spark.sql(
                f"CREATE TABLE {_name(path, kind)} ({columns}) USING parquet PARTITIONED BY (ref_chrom) "
                f"CLUSTERED BY ({_DEALT[kind]}) SORTED BY ({', '.join(_SORT[kind])}) INTO {rows[kind].buckets} BUCKETS LOCATION '{path}/{kind}'"
            )
            spark.sql(f"ALTER TABLE {_name(path, kind)} RECOVER PARTITIONS")
    one = rows["blocks"]
    return Lookup(spark, path, one.bin_width, one.buckets, one.stretch, one.has_long)


def _top_level(columns: str) -> list[str]:
    """The column texts of a schema, cut at commas outside brackets."""
    out, depth = [""], 0
    for ch in columns:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out
