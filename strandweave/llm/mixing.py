"""Mixing sources to target weights by nested hash thresholds.

A document is taken once for every whole time that its source's target holds the
source, and once more if its hash lies under the source's threshold. Thresholds
come from histograms of words by source and hash digit: the digit in which the
rest of the target is reached is the boundary bucket, and only its documents are
counted again, by their next digit. Nothing is sorted but digits of one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm.common import WORD, save

DIGIT_BITS = 15
DIGITS = 4  # 60 bits of the hash


def text_size(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of the id as text, a line end and the text (null: empty), as a long."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def rank_sources(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds ``weight`` to one row per source: ``weights`` in turn, by code point, null last.

    Ranks come from range partitions, so no task sees all sources.
    """
    parts = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    parts = save(parts, "sources")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    rank = F.col("_base") + F.row_number().over(within) - 1
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    return parts.join(sizes, "_part").withColumn("weight", picked).drop("_part", "_base")


def set_targets(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Adds ``target`` to rows of ``source, source_size, weight``.

    Targets follow the weights and sum to the sum of the sizes; one that would
    exceed ``max_epochs`` times its source's size stops there, and what it cannot
    take goes to the others by weight. Each round stops every source above its
    limit at the common price of a weight; two sums come back to the driver.
    """
    rows = save(sources.withColumn("_limit", F.col("source_size") * float(max_epochs)), "weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    price = 0.0
    while True:
        full = F.col("_limit") <= F.col("weight") * F.lit(price)
        held, open_weight = rows.agg(
            F.coalesce(F.sum(F.when(full, F.col("_limit"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        new = (total - held) / open_weight if open_weight else price
        if new <= price:
            break
        price = new
    return rows.withColumn("target", F.least(F.col("_limit"), F.col("weight") * F.lit(price))).drop("_limit")


def thresholds(hashed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: ``copies`` of every document, and ``cut``: hashes under it are taken once more.

    ``hashed`` has ``source, size, h``. The documents of one hash value are taken
    together; the last value is taken if that brings the sum nearer to the target.
    """
    known = targets.where("source_size > 0")
    copies = F.floor(F.col("target") / F.col("source_size"))
    goals = known.select(
        F.col("source").alias("_s"), copies.cast("long").alias("copies"),
        (F.col("target") - copies * F.col("source_size")).alias("_left"), F.lit(0).cast("long").alias("cut"),
    )
    rows = hashed.where("size > 0").select("source", "size", "h")
    for digit in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - 1 - digit)
        scope = F.shiftright("h", shift + DIGIT_BITS)
        # Only the documents of each source's boundary bucket are counted on.
        inside = rows.join(
            goals.select("_s", F.shiftright("cut", shift + DIGIT_BITS).alias("_scope")),
            F.col("source").eqNullSafe(F.col("_s")) & (scope == F.col("_scope")),
        )
        sums = inside.groupBy("_s", F.shiftright("h", shift).alias("_d")).agg(F.sum("size").alias("_n"))
        ordered = Window.partitionBy("_s").orderBy("_d")
        sums = sums.withColumn("_to", F.sum("_n").over(ordered)).withColumn("_from", F.col("_to") - F.col("_n"))
        found = sums.join(goals.select(F.col("_s").alias("_g"), "_left"), F.col("_s").eqNullSafe(F.col("_g")))
        found = found.where("_from <= _left and _left < _to").select(
            F.col("_g").alias("_b"), F.shiftleft("_d", shift).alias("_cut"), "_from", "_n")
        goals = goals.select("_s", "copies", "_left", "cut").join(found, F.col("_s").eqNullSafe(F.col("_b")), "left").select(
            "_s", "copies", (F.col("_left") - F.coalesce("_from", F.lit(0))).alias("_left"),
            # A target that no digit reaches (all documents are under it) puts the cut beyond all hashes.
            F.coalesce("_cut", F.when(F.lit(digit == 0) & (F.col("_left") > 0), F.lit(1 << (DIGIT_BITS * DIGITS))), "cut").alias("cut"),
            F.coalesce("_n", F.lit(0)).alias("_n"))
        goals = save(goals, "cuts") if digit < DIGITS - 1 else goals
    last = F.col("_n") > 0
    nearer = last & (F.col("_n") - F.col("_left") < F.col("_left"))
    return goals.select("_s", "copies", (F.col("cut") + F.when(nearer, 1).otherwise(0)).alias("cut"))


def plan(rows: DataFrame, weights: tuple[float, ...], max_epochs: float) -> DataFrame:
    """Per source of ``rows`` (``source, size, h``): ``_s, source_size, target, copies, cut``."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = save(set_targets(rank_sources(sources, weights), max_epochs), "targets")
    cuts = save(thresholds(rows, targets), "thresholds")
    return save(targets.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias("_s"), "source_size", "target",
        F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("cut", F.lit(0)).alias("cut")), "mix")


def _sized(docs: DataFrame) -> DataFrame:
    h = doc_hash(F.col("doc_id"), F.col("text"))
    return save(docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), h.alias("h")), "sizes")


def _times() -> Column:
    return F.col("copies") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 3.0) -> DataFrame:
    """Per document ``doc_id, source, size, source_size, target, taken``.

    ``taken`` is ``size`` times how often the mix holds the document. Null texts
    have size 0; a null source is a source like any other, the last. Rows with
    the same id and the same text share one hash and so one fate within a source;
    null or repeated ids alone do not. A source of size 0 has target 0. An empty
    table gives no rows.
    """
    rows = _sized(docs)
    return rows.join(plan(rows, weights, max_epochs), F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def repeat(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 3.0) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as ``mix`` takes it."""
    per_source = plan(_sized(docs), weights, max_epochs)
    rows = docs.select(F.struct("*").alias("_row"), F.col("source"), doc_hash(F.col("doc_id"), F.col("text")).alias("h"))
    taken = rows.join(per_source, F.col("source").eqNullSafe(F.col("_s"))).where(_times() > 0)
    return taken.select("_row", F.explode(F.sequence(F.lit(1), _times().cast("int")))).select("_row.*")
