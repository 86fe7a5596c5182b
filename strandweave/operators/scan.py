"""Running min/max along a coordinate, without one task per chromosome.

A window partitioned by chromosome puts a whole chromosome of a whole sample in
one task. Here the coordinate is cut into bins. Each bin is reduced to one
value (with map-side partial aggregation), the few bin values are scanned per
key, and each row combines the carry of its bin with a window inside the bin.
Where many rows may share a position, bins are cut again by exact position and
by slices of the input order, so no window ever grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators.overlap import position_bin

DEFAULT_BIN = 1 << 20
DEFAULT_SPLIT = 1_000_000


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column | Sequence[Column],
    out: str | Sequence[str],
    fn: Callable[..., Column] = F.max,
    inclusive: bool = False,
    bin_width: int = DEFAULT_BIN,
    tie: str | None = None,
    split_rows: int = DEFAULT_SPLIT,
) -> DataFrame:
    """Adds ``out``: min or max of ``value`` over the earlier rows of the same keys.

    Several values are followed in one pass; ``out`` then names as many columns.
    Rows without a key or a position are dropped. ``order[0]`` is the position and ``order`` must be total up to identical
    rows. ``tie`` is the numeric column that orders rows of one position; leave
    it out when a position occurs once per key, for then a bin holds at most
    ``bin_width`` rows and needs no second cut. Bins of more than ``split_rows``
    rows are cut; one slice spans ``split_rows`` numbers of ``tie``.
    """
    pick = F.greatest if fn is F.max else F.least
    keys, pos = list(keys), order[0]
    upto = 0 if inclusive else -1
    outs, values = ([out], [value]) if isinstance(out, str) else (list(out), list(value))
    which = range(len(outs))
    binned = df.withColumn("__bin", position_bin(F.col(pos), bin_width))
    for c in [*keys, "__bin"]:
        binned = binned.filter(F.col(c).isNotNull())
    # One column for keys and bin: Spark would drop a constant key from a window's
    # partitioning, but not from a repartition, and then move the rows again.
    rest = [c for c in df.columns if c not in keys]
    binned = binned.select(F.struct(*keys, "__bin").alias("__spot"), *rest)

    def valued(rows: DataFrame) -> DataFrame:
        """The values are made after rows have moved, so that they need not move too."""
        return rows.withColumns({f"__val{i}": values[i] for i in which})

    def unkeyed(rows: DataFrame, spot: str = "__spot") -> DataFrame:
        return rows.withColumns({c: F.col(spot)[c] for c in [*keys, "__bin"]})

    def tops(rows: DataFrame, by: str, name: str) -> DataFrame:
        return rows.groupBy(by).agg(*[fn(f"__val{i}").alias(f"{name}{i}") for i in which])

    def inside(rows: DataFrame, by: str) -> DataFrame:
        w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
        return rows.withColumns({f"__in{i}": fn(f"__val{i}").over(w) for i in which}).drop(*[f"__val{i}" for i in which])

    def before(rows: DataFrame, key: str, by: Sequence[str], along: Sequence[str], top: str, name: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(key, *[fn(f"{top}{i}").over(w).alias(f"{name}{i}") for i in which])

    few = binned
    if tie is not None:
        # A crowded bin has ``split_rows`` rows at least, so this list is short.
        crowded = binned.groupBy("__spot").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > split_rows).select("__spot")
        few = binned.join(F.broadcast(crowded), "__spot", "left_anti")
    few = valued(unkeyed(few.repartition("__spot")))
    found = [inside(few, "__spot")]
    bins = tops(few, "__spot", "__top")
    if tie is not None:
        many = binned.join(F.broadcast(crowded), "__spot", "left_semi").withColumn("__slice", position_bin(F.col(tie), split_rows))
        many = valued(unkeyed(many.withColumn("__leaf", F.struct("__spot", pos, "__slice")).repartition("__leaf")))
        leaves = tops(many, "__leaf", "__end")
        held = leaves.withColumn("__spot", F.col("__leaf")["__spot"])
        bins = bins.unionByName(held.groupBy("__spot").agg(*[fn(f"__end{i}").alias(f"__top{i}") for i in which]))
        parts = inside(many, "__leaf").join(before(held, "__leaf", ["__spot"], ["__leaf"], "__end", "__part"), "__leaf")
        found.append(parts.withColumns({f"__in{i}": pick(f"__part{i}", f"__in{i}") for i in which}))
    carry = before(unkeyed(bins), "__spot", keys, ["__bin"], "__top", "__carry")
    done = []
    for rows in found:
        carried = rows.join(carry, "__spot").withColumns({o: pick(f"__carry{i}", f"__in{i}") for i, o in enumerate(outs)})
        done.append(carried.select(*df.columns, *outs))
    return reduce(DataFrame.unionByName, done)
