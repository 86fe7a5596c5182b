"""Interval algebra: merging, clustering, bounding, choosing."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators.overlap import position_bin
from strandweave.operators.scan import DEFAULT_BIN

# Fixed value: assembly pieces farther apart than this are different clusters.
CLUSTER_GAP = 50_000
#: Partitions of islands for each shuffle partition of the session.
SPREAD = 4


def islands(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start",
    end: str = "end",
    max_gap: int = 0,
    bin_width: int = DEFAULT_BIN,
) -> DataFrame:
    """Groups of intervals no more than ``max_gap`` apart; touching counts as overlap.

    Returns ``keys, start, end, covered, pieces``: the envelope, the bases
    covered by the union, and the number of disjoint pieces inside. Intervals
    are cut where bins end, so a bin makes its islands on its own; copies are
    bounded by ``rows + total length / bin_width``. Equal starts of a batch are
    reduced to the longest before rows are moved. Only islands within
    ``max_gap`` of a bin's end can go on in another bin. There are at most two of these in a bin, and these alone meet per key.
    The rows pass once, through two shuffles of ``SPREAD`` times the usual
    number of partitions, as a task sorts and groups what it holds.
    """
    keys = list(keys)
    here = [*keys, "__bin"]
    solid = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"))
    first = position_bin(F.col("__s"), bin_width)
    last = F.greatest(first, position_bin(F.col("__e") - 1, bin_width))
    cut = solid.withColumn("__first", first).withColumn("__bin", F.explode(F.sequence(first, last)))
    low, high = F.col("__bin") * bin_width, (F.col("__bin") + 1) * bin_width
    cut = cut.select(*here, F.when(F.col("__bin") == F.col("__first"), F.col("__s")).otherwise(low).alias("start"), F.least("__e", high).alias("end"))
    spread = SPREAD * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def reduce_starts(batches):
        """Of rows that are alike but for ``end`` only the one with the largest; a batch at a time."""
        for batch in batches:
            *same, _ = names = batch.schema.names
            found = pa.Table.from_batches([batch]).group_by(same).aggregate([("end", "max")]).rename_columns(names)
            yield from found.combine_chunks().to_batches()

    longest = cut.mapInArrow(reduce_starts, cut.schema).repartition(spread, *here)

    def reach_before(*parts: str):
        along = Window.partitionBy(*parts).orderBy("start")
        return F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), along.rowsBetween(Window.unboundedPreceding, 0)

    reach = F.col("reach")
    opened = F.when(reach.isNull() | (F.col("start") > reach + max_gap), F.col("start"))
    before, upto = reach_before(*here)
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce("reach", "start")), F.lit(0).cast("bigint"))
    parts = longest.withColumn("reach", before).withColumn("island", F.max(opened).over(upto)).groupBy(*here, F.col("island").alias("start")).agg(
        F.max("end").alias("end"), F.sum(fresh).alias("covered"),
        F.count_if(reach.isNull() | (F.col("start") > reach)).alias("pieces"),
    )
    edge = (F.col("start") - max_gap <= low) | (F.col("end") + max_gap >= high)
    parts = parts.withColumn("__side", F.when(edge, F.lit(-1).cast("bigint")).otherwise(F.col("__bin")))
    side = [*keys, "__side"]
    before, upto = reach_before(*side)
    touches = F.count_if(reach.isNotNull() & (F.col("start") <= reach))
    return (
        parts.repartition(spread, *side)
        .withColumn("reach", before)
        .withColumn("island", F.max(opened).over(upto))
        .groupBy(*side, "island")
        .agg(F.max("end").alias("end"), F.sum("covered").alias("covered"), (F.sum("pieces") - touches).alias("pieces"))
        .select(*keys, F.col("island").alias("start"), "end", "covered", "pieces")
    )


def merge_intervals(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start",
    end: str = "end",
    bin_width: int = DEFAULT_BIN,
) -> DataFrame:
    """Union of overlapping or touching intervals per key."""
    return islands(df, keys, start, end, 0, bin_width).select(*keys, "start", "end")


def merge_dealt(df: DataFrame, keys: Sequence[str], deal: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """``merge_intervals`` for keys of few intervals each, as windows are: rows move once, by ``deal``, some of the keys.

    The result stays dealt so: what goes on by these keys, in this order, moves no
    row again. A key's intervals are not cut into bins; one task sorts and passes them.
    """
    keys = list(keys)
    spread = SPREAD * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    solid = df.select(*keys, F.col(start).alias("start"), F.col(end).alias("end")).where("start is not null and end is not null")
    along = Window.partitionBy(*keys).orderBy("start")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), F.col("start"))
    parts = solid.repartition(spread, *deal).withColumn("reach", reach)
    parts = parts.withColumn("island", F.max(opened).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(*keys, "island").agg(F.max("end").alias("end")).select(*keys, F.col("island").alias("start"), "end")


def cluster_intervals(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start",
    end: str = "end",
    max_gap: int = CLUSTER_GAP,
    bin_width: int = DEFAULT_BIN,
) -> DataFrame:
    """Proximity clusters with their covered bases and piece count."""
    solid = df.filter(F.col(end) > F.col(start))
    return islands(solid, keys, start, end, max_gap, bin_width)


def best_cluster(clusters: DataFrame, keys: Sequence[str], contig: str = "asm_chrom") -> DataFrame:
    """Per key the cluster covering most bases; then the tightest; then the first."""
    first = F.min(
        F.struct(
            (-F.col("covered")).alias("rank"),
            (F.col("end") - F.col("start")).alias("width"),
            contig,
            "start",
            "end",
            "covered",
            "pieces",
        )
    ).alias("best")
    fields = [contig, "start", "end", "covered", "pieces"]
    return clusters.groupBy(*keys).agg(first).select(*keys, *[f"best.{f}" for f in fields])


def bounding_region(hits: DataFrame, keys: Sequence[str], contig: str = "asm_chrom") -> DataFrame:
    """Per key the bounding interval of the first contig by name; start is at least 1."""
    lo, hi = F.least("asm_start", "asm_end"), F.greatest("asm_start", "asm_end")
    per_contig = hits.groupBy(*keys, contig).agg(
        F.greatest(F.min(lo), F.lit(1).cast("bigint")).alias("start"), F.max(hi).alias("end")
    )
    return (
        per_contig.filter(F.col("end") >= F.col("start"))
        .groupBy(*keys)
        .agg(F.min(F.struct(contig, "start", "end")).alias("box"))
        .select(*keys, f"box.{contig}", "box.start", "box.end")
    )


def longest_block(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Longest reference span per key."""
    return blocks.groupBy(*keys).agg(
        F.max(F.col("ref_end") - F.col("ref_start")).alias("max_block_len")
    )
