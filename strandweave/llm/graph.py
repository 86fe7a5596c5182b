"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import save


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` (longs); the root is the component's smallest node.

    Alternates two star steps: every node links its larger neighbours to its
    smallest one, then its smaller neighbours. Each round is two aggregations
    with map-side minima and two joins, and is written before the next, so no
    node's neighbours are ever gathered. Ends when a round changes nothing;
    only a count and a checksum reach the driver.
    """
    edges = save(_down(edges.select("a", "b")), "edges")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("_u")).agg(F.least(F.min("b"), F.min("a")).alias("_m"))
        large = both.join(least, F.col("a") == F.col("_u")).where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = save(_down(large), "large")
        low = large.groupBy(F.col("a").alias("_u")).agg(F.min("b").alias("_m"))
        small = large.join(low, F.col("a") == F.col("_u")).where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        edges = save(_down(small.union(low.select("_u", "_m"))), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end; no loops."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
