"""Binned coverage and per-region read statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import sam

#: Bins that a task fills at a time.
_CELLS = 1 << 18


def binned_coverage(
    views: DataFrame, overlaps: DataFrame, num_bins: int, key: Sequence[str] = ("region_id",)
) -> DataFrame:
    """Reads touching each bin of each view, in total and per haplotype.

    ``views`` holds ``key, view_start, view_end``; ``overlaps`` the same columns
    with the read's ``start, end, hp``; a key is not null. Each read adds one at
    its first bin and takes one away after its last. Only these edges are
    shuffled, summed map-side; a view gets the list of its steps, at most one
    per bin, and is filled up to ``num_bins`` bins where the list arrives; only
    lists are grouped, and a bin is a row no earlier than in the result. A
    running sum gives the depth. Every bin appears, empty ones too; the last
    bins of a short view may end before they start.
    """
    key = list(key)
    if num_bins < 1:
        raise ValueError("num_bins must be >= 1")
    span = F.col("view_end") - F.col("view_start")
    size = F.greatest(F.lit(1).cast("bigint"), ((span + (num_bins - 1)) - (span + (num_bins - 1)) % num_bins) / num_bins).cast("bigint")
    view = [*key, "view_start", "view_end"]
    shown = views.filter(span > 0).select(*view).distinct()
    zero = F.lit(0).cast("bigint")

    vs, ve = F.col("view_start"), F.col("view_end")
    lo = F.greatest("start", "view_start") - vs
    hi = F.greatest(F.least("end", "view_end") - vs - 1, zero)
    step = lambda x: ((x - x % size) / size).cast("int")
    seen = overlaps.filter((span > 0) & (F.col("end") >= vs) & (F.col("start") <= ve))
    reach = seen.select(
        *key, "view_start", "view_end", "hp",
        step(lo).alias("first"), F.least(step(hi), F.lit(num_bins - 1)).alias("last"),
    ).filter(F.col("first") <= F.col("last"))
    edge = reach.select(
        *key, "view_start", "view_end", "hp",
        F.explode(
            F.array(
                F.struct(F.col("first").alias("bin"), F.lit(1).cast("bigint").alias("d")),
                F.struct((F.col("last") + 1).alias("bin"), F.lit(-1).cast("bigint").alias("d")),
            )
        ).alias("e"),
    ).filter(F.col("e.bin") < num_bins)
    edges = edge.select(
        *key, "view_start", "view_end", F.col("e.bin").alias("bin"), F.col("e.d").alias("d"),
        F.when(F.col("hp") == 1, F.col("e.d")).otherwise(zero).alias("d1"),
        F.when(F.col("hp") == 2, F.col("e.d")).otherwise(zero).alias("d2"),
    )
    steps = edges.groupBy(*view, "bin").agg(F.sum("d").alias("d"), F.sum("d1").alias("d1"), F.sum("d2").alias("d2"))
    steps = steps.groupBy(*view).agg(F.collect_list(F.struct("bin", "d", "d1", "d2")).alias("steps"))
    lists = shown.join(steps, view, "left").select(*key, "view_start", "view_end", size.alias("size"), "steps")
    kinds = ", ".join(f"`{c}` {lists.schema[c].dataType.simpleString()}" for c in key)
    names = [*key, "bin", "bin_start", "bin_end", "depth", "hap1_depth", "hap2_depth"]

    def fill(batches):
        """Every bin of some views at a time, as many as have some hundred thousand bins."""
        rows = max(1, _CELLS // num_bins)
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                n, found = part.num_rows, part.column("steps")
                at = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))
                step = found.flatten()
                depth = np.zeros((3, n, num_bins), np.int64)
                place = step.field("bin").to_numpy(zero_copy_only=False)
                for i, d in enumerate(("d", "d1", "d2")):
                    depth[i, at, place] = step.field(d).to_numpy(zero_copy_only=False)
                depth = depth.cumsum(axis=2).reshape(3, -1)
                vs, ve, width = (part.column(len(key) + i).to_numpy()[:, None] for i in range(3))
                start = vs + np.arange(num_bins) * width
                own = pa.array(np.repeat(np.arange(n), num_bins))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i).take(own) for i in range(len(key))), pa.array(np.tile(np.arange(num_bins, dtype=np.int32), n)),
                     pa.array(start.ravel()), pa.array(np.minimum(start + width, ve).ravel()), *map(pa.array, depth)], names)

    return lists.mapInArrow(fill, f"{kinds}, bin int, bin_start long, bin_end long, depth long, hap1_depth long, hap2_depth long")


def read_stats(reads: DataFrame, key: Sequence[str] = ("region_id",)) -> DataFrame:
    """Counts and the whole-number average mapping quality (null when none is known)."""
    total, known = F.sum(F.col("mapq").cast("bigint")), F.count("mapq")
    return reads.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_reads"),
        F.count_if(sam.has_flag(F.col("flags"), sam.REVERSED)).alias("n_reverse"),
        F.count_if(sam.has_flag(F.col("flags"), sam.SECONDARY)).alias("n_secondary"),
        F.floor(F.try_divide(total, known)).cast("bigint").alias("avg_mapq"),
    )


def compare_read_sets(
    overlaps: DataFrame, key: Sequence[str] = ("region_id",), track: str = "track"
) -> DataFrame:
    """Names seen in the ref, hap1 and hap2 tracks as seven disjoint counts and a total.

    One aggregation per name and one per region replace the set joins.
    """
    key = list(key)
    panels = overlaps.filter(F.col(track).isin("ref", "hap1", "hap2"))
    names = panels.groupBy(*key, "name").agg(
        F.max(F.col(track) == "ref").alias("r"),
        F.max(F.col(track) == "hap1").alias("a"),
        F.max(F.col(track) == "hap2").alias("b"),
    )
    r, a, b = F.col("r"), F.col("a"), F.col("b")
    return names.groupBy(*key).agg(
        F.count_if(r & ~a & ~b).alias("ref_only"),
        F.count_if(~r & a & ~b).alias("hap1_only"),
        F.count_if(~r & ~a & b).alias("hap2_only"),
        F.count_if(r & a & ~b).alias("ref_and_hap1"),
        F.count_if(r & ~a & b).alias("ref_and_hap2"),
        F.count_if(~r & a & b).alias("hap1_and_hap2"),
        F.count_if(r & a & b).alias("all_three"),
        F.count(F.lit(1)).alias("total_unique"),
    )


def read_summary(reads: DataFrame) -> DataFrame:
    """One line per read: span, strand, quality, haplotype and number of indels."""
    length = F.greatest(F.col("end") - F.col("start"), F.lit(0).cast("bigint")) + 1
    return reads.select(
        "name", "start", "end",
        sam.has_flag(F.col("flags"), sam.REVERSED).alias("is_reverse"),
        "mapq", "hp",
        F.size("indels").alias("indel_count"),
        length.alias("alignment_length"),
    )
