"""Packing reads into pileup lanes.

Greedy rule: reads in order of start; a read goes to the lane that ended
earliest (lowest lane on ties) if that end lies more than ``READ_GAP`` before
the start, else to a new lane. Which lane is free depends on every earlier
choice of the same group, so one group is one ordered pass; groups run in
parallel. Only the key, two positions and a row id travel. Spark sorts them
(spilling when it must) and the pass keeps one number per open lane, never the
group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READ_GAP = 5


def pack_lanes(
    reads: DataFrame, key: Sequence[str], seq: str = "read_seq", gap: int = READ_GAP
) -> DataFrame:
    """``key, seq, lane``. ``seq`` breaks ties between equal starts and is unique per key."""
    key = list(key)
    if not key:
        raise ValueError("a key is needed: each of its groups is packed in one task")
    slim = reads.select(*key, seq, "start", "end")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, open_lanes = None, []
        for pdf in batches:
            lanes = []
            groups = zip(*[pdf[k].astype(object).where(pdf[k].notna(), None) for k in key])
            for group, start, end in zip(groups, pdf["start"], pdf["end"]):
                if group != current:
                    current, open_lanes = group, []
                if open_lanes and start > open_lanes[0][0] + gap:
                    lane = open_lanes[0][1]
                    heapq.heapreplace(open_lanes, (end, lane))
                else:
                    lane = len(open_lanes)
                    heapq.heappush(open_lanes, (end, lane))
                lanes.append(lane)
            out = pdf[[*key, seq]].copy()
            out["lane"] = pd.Series(lanes, index=out.index, dtype="int32")
            yield out

    schema = slim.select(*key, seq).withColumn("lane", F.lit(0)).schema
    return slim.repartition(*key).sortWithinPartitions(*key, "start", seq).mapInPandas(assign, schema)


def pack_lanes_by_haplotype(
    reads: DataFrame, key: Sequence[str], seq: str = "read_seq", gap: int = READ_GAP
) -> DataFrame:
    """Haplotype 1 on top, then 2, then the rest, a blank lane between non-empty groups."""
    key = list(key)
    group = F.when(F.col("hp") == 1, 1).when(F.col("hp") == 2, 2).otherwise(3)
    packed = pack_lanes(reads.withColumn("hp_group", group), [*key, "hp_group"], seq, gap)
    height = lambda g: F.coalesce(
        F.max(F.when(F.col("hp_group") == g, F.col("lane") + 1)), F.lit(0)
    )
    tops = packed.groupBy(*key).agg(height(1).alias("n1"), height(2).alias("n2"))
    second = F.when(F.col("n1") > 0, F.col("n1") + 1).otherwise(0)
    used = second + F.col("n2")
    third = F.when(F.col("n2") > 0, used + 1).otherwise(second)
    offset = F.when(F.col("hp_group") == 1, 0).when(F.col("hp_group") == 2, second).otherwise(third)
    return packed.join(tops, key).select(*key, seq, (F.col("lane") + offset).cast("int").alias("lane"))
