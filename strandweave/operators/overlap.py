"""Interval-overlap and point-in-interval joins as binned equi-joins.

A plain overlap condition is planned as a nested loop. Here both sides are cut
into fixed-width position bins and joined on ``keys + bin``, which Spark hashes
or sorts, spreads over the cluster and, under adaptive execution, splits when a
bin is crowded. An interval is copied once per bin it touches, so the copies
number at most ``rows + total length / bin_width``: choose a width near the
typical interval length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def position_bin(pos: Column, width: int) -> Column:
    """Bin of a position; positions below zero share bin 0."""
    at = F.greatest(pos, F.lit(0).cast("bigint"))
    return ((at - at % width) / width).cast("bigint")


def _with_bins(df: DataFrame, start: str, end: str, width: int, first: str) -> DataFrame:
    solid = df.filter((F.col(end) > F.col(start)) & (F.col(end) > 0))
    return solid.withColumn(first, position_bin(F.col(start), width)).withColumn(
        "__bin", F.explode(F.sequence(F.col(first), position_bin(F.col(end) - 1, width)))
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    bin_width: int,
    closed: bool = False,
) -> DataFrame:
    """Pairs with equal ``keys`` whose intervals share a position.

    Spans are half-open column pairs; ``closed=True`` means inclusive ends.
    Empty intervals match nothing. Column names other than the keys must differ
    between the sides. Each pair is kept in one bin only, the first one both
    intervals touch, so no distinct is needed.
    """
    (ls, le), (rs, re) = left_span, right_span
    if closed:
        left, right = left.withColumn("__le", F.col(le) + 1), right.withColumn("__re", F.col(re) + 1)
        le, re = "__le", "__re"
    a = _with_bins(left, ls, le, bin_width, "__lfirst")
    b = _with_bins(right, rs, re, bin_width, "__rfirst")
    pairs = a.join(b, [*keys, "__bin"]).filter(
        (F.col(ls) < F.col(re))
        & (F.col(le) > F.col(rs))
        & (F.col("__bin") == F.greatest("__lfirst", "__rfirst"))
    )
    return pairs.drop("__bin", "__lfirst", "__rfirst", "__le", "__re")


def point_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    point: str,
    span: tuple[str, str],
    bin_width: int,
    how: str = "inner",
) -> DataFrame:
    """Half-open intervals holding a point. A point is in one bin, so it is never copied."""
    start, end = span
    on = [*keys, "__bin"]
    a = points.withColumn("__bin", position_bin(F.col(point), bin_width))
    b = _with_bins(intervals, start, end, bin_width, "__first").drop("__first")
    b = b.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(on)})
    cond = (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))
    for i, k in enumerate(on):
        cond = cond & (F.col(k) == F.col(f"__k{i}"))
    return a.join(b, cond, how).drop("__bin", *[f"__k{i}" for i in range(len(on))])
