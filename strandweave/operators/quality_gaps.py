"""Predecessors of blocks for every mapping-quality threshold, in one pass.

Raising the threshold takes blocks away and so changes which block comes before
another. For one block the thresholds fall into ranges with the same
predecessor: of the earlier blocks only those matter that no other reaches as
far with the same quality or a better one, at most one per quality. Blocks in
order are cut into runs of rows. Each run is reduced to its farthest block of
each quality, these are carried forward from run to run, and each run is passed
once with that list at hand. No row is copied per threshold, and a task holds
one list.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.cigar_arrays import short_index
from strandweave.operators.overlap import position_bin
from strandweave.session import stored

RUN_ROWS = 65_536
KEYS = ["sample_id", "hap", "ref_chrom"]
FLANK = ["ref_start", "ref_end", "asm_chrom", "asm_start", "asm_end", "strand", "mapq"]


class Frontier:
    """Blocks by rising quality and falling reach; items are ``(quality, reach, row)``."""

    def __init__(self):
        self.quality: list[int] = []
        self.items: list[tuple] = []

    def add(self, quality: int, reach: int, row) -> None:
        """Rows come in order; of two that reach as far the earlier one counts."""
        at = bisect_left(self.quality, quality)
        if at < len(self.items) and self.items[at][1] >= reach:
            return
        upto = at + 1 if at < len(self.items) and self.quality[at] == quality else at
        first = at
        while first and self.items[first - 1][1] < reach:
            first -= 1
        self.quality[first:upto] = [quality]
        self.items[first:upto] = [(quality, reach, row)]

    def before(self, quality: int):
        """``(row, over, upto)``: the predecessor at thresholds above ``over`` up to ``upto``, which is ``quality`` at most."""
        over = None
        for q, _, row in self.items:
            yield row, over, min(q, quality)
            over = q
            if q >= quality:
                return


class _Rows:
    """Batches in order, each behind the earlier rows that are still in the front; the front holds row numbers.

    Only the numbers that decide are made Python objects; rows are taken by number.
    """

    def __init__(self, batches, names: Sequence[str], same: Sequence[str]):
        self.batches, self.names, self.same = batches, list(names), list(same)
        self.front, self.here, self.table = Frontier(), None, None

    def __iter__(self):
        """``(first row number, whether each row opens a new run or key)`` of each batch; ``table`` holds the rows."""
        for batch in self.batches:
            if not batch.num_rows:
                continue
            fresh = None
            for c in self.same:
                col = batch.column(c)
                other = pc.not_equal(col.slice(1), col.slice(0, len(col) - 1))
                fresh = other if fresh is None else pc.or_(fresh, other)
            first = tuple(batch.column(c)[0].as_py() for c in self.same)
            given = pa.Table.from_batches([batch]).select(self.names)
            kept = [row for _, _, row in self.front.items]
            base = len(kept)
            self.table = pa.concat_tables([self.table.take(pa.array(kept, pa.int64())), given]).combine_chunks() if base else given
            self.front.items = [(q, reach, i) for i, (q, reach, _) in enumerate(self.front.items)]
            yield base, [first != self.here, *(f is not False for f in fresh.to_pylist())]  # beside a null all is new
            self.here = tuple(batch.column(c)[len(batch) - 1].as_py() for c in self.same)

    def numbers(self, name: str) -> list:
        return self.table.column(name).to_pylist()

    def take(self, rows: Sequence[int], columns: Sequence[str]) -> list[pa.Array]:
        found = self.table.select(columns).take(pa.array(rows, pa.int64())).combine_chunks()
        return [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in found.columns]


def predecessors(blocks: DataFrame, keys: Sequence[str], flank: Sequence[str], run_rows: int = RUN_ROWS) -> DataFrame:
    """``keys, block_seq, over, upto, prev, nxt``: each block's touching or clear predecessor at thresholds ``over < t <= upto``.

    ``flank`` are the fields of ``prev`` and ``nxt``, ``ref_start``, ``ref_end``
    and ``mapq`` among them. ``over`` is null where there is no lower bound.
    The predecessor is the earlier block reaching farthest, the first of them on
    ties; pairs that overlap are left out. Blocks without a key, a place or a
    quality take no part. Rows are stored once, as the cut into runs must not
    change while it is used.
    """
    spark, keys = blocks.sparkSession, list(keys)
    rest = [c for c in ("ref_end", "asm_chrom", "asm_start", "asm_end", "strand", "mapq") if c in flank]
    order = [*keys, "ref_start", "block_seq", *rest]
    columns = [*keys, "block_seq", *flank]
    solid = blocks.select(*columns)
    for c in [*keys, "ref_start", "ref_end", "mapq"]:
        solid = solid.where(F.col(c).isNotNull())
    bits = max(run_rows, 2).bit_length() - 1
    placed = solid.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(placed.withColumn("run", F.shiftright(F.monotonically_increasing_id(), bits)), "runs")

    kind = lambda names, frame: ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in names)
    same = ["run", *keys]
    best = F.struct((-F.col("ref_end")).alias("_far"), "ref_start", "block_seq", *[c for c in rest if c != "mapq"])
    # Stored, as it is used three times: a row per run and quality.
    lists = stored(placed.groupBy(*same, "mapq").agg(F.min(best).alias("_best")), "lists")
    grid = lists.select(*keys, "run").distinct().join(lists.select(*keys, "mapq").distinct(), keys)
    before = Window.partitionBy(*keys, "mapq").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carry = grid.join(lists, [*keys, "run", "mapq"], "left").select(*keys, "run", "mapq", F.min("_best").over(before).alias("_best")).where("_best is not null")
    carry = carry.select(*[F.col(c) if c in keys or c == "mapq" else F.col("_best")[c].alias(c) for c in columns], "run", F.lit(0).alias("_kind"))
    carry = carry.withColumn("_far", F.col("ref_end"))

    rows = placed.withColumn("_kind", F.lit(1)).withColumn("_far", F.lit(0).cast("bigint"))
    passed = rows.unionByName(carry).repartition("run").sortWithinPartitions("run", "_kind", *keys, F.col("_far").desc(), *order[len(keys):])
    out = [*keys, "block_seq", "over", "upto", *[f"p_{c}" for c in flank], *[f"n_{c}" for c in flank]]
    out_kind = (
        f"{kind([*keys, 'block_seq'], placed)}, over int, upto int, "
        + ", ".join(f"{side}_{c} {placed.schema[c].dataType.simpleString()}" for side in "pn" for c in flank)
    )

    def pass_runs(batches):
        rows = _Rows(batches, [*columns, "_kind"], same)
        for base, fresh in rows:
            quality, reach, start, block = (rows.numbers(c)[base:] for c in ("mapq", "ref_end", "ref_start", "_kind"))
            found = []
            for i, (new, own, upto, at, is_block) in enumerate(zip(fresh, quality, reach, start, block), base):
                if new:
                    rows.front = Frontier()
                if is_block:
                    # What Frontier.before gives, without a generator for each row.
                    over = None
                    for level, far, prev in rows.front.items:
                        if far <= at:
                            found.append((prev, i, over, level if level < own else own))
                        if level >= own:
                            break
                        over = level
                rows.front.add(own, upto, i)
            prevs, nexts, overs, uptos = zip(*found) if found else ((), (), (), ())
            if prevs:
                level = [pa.array(overs, pa.int32()), pa.array(uptos, pa.int32())]
                own, before, after = rows.take(nexts, [*keys, "block_seq"]), rows.take(prevs, flank), rows.take(nexts, flank)
                yield pa.RecordBatch.from_arrays([*own, *level, *before, *after], out)

    pairs = passed.select("run", *columns, "_kind").mapInArrow(pass_runs, out_kind)
    side = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in flank])
    return pairs.select(*keys, "block_seq", "over", "upto", side("p").alias("prev"), side("n").alias("nxt"))


_INDEX = "n_ops long, whole_lo long, whole_hi long, asm_total long, upto long, sizes array<long>, codes string"
_BEFORE = [c for c in FLANK if c != "ref_start"]


def passed_stretches(rows: DataFrame, blocks: DataFrame, width: int, cell: Column, parts: int) -> DataFrame:
    """``rows`` dealt by ``cell`` with what their CIGARs say and ``gaps``, the predecessors of each: ``over, upto`` and their fields.

    A row of ``rows`` is a block in one ``stretch`` of ``width`` bases that it
    touches; it has its predecessors in the first. Each stretch is reduced to
    its farthest block of each quality, which are carried forward; then rows and
    what is carried to them are moved once, and a task passes its stretches.
    Predecessors may touch without being a gap. Rows whose
    ``cigar`` is null have their ``n_ops`` and the rest already.
    """
    known = lambda df: [F.col(c).isNotNull() for c in (*KEYS, "ref_start", "ref_end", "mapq")]
    solid = blocks.select(*KEYS, "block_seq", *FLANK)
    for has in known(solid):
        solid = solid.where(has)
    rest = [c for c in FLANK if c not in ("ref_start", "mapq")]
    best = F.struct((-F.col("ref_end")).alias("_far"), "ref_start", "block_seq", *rest)
    first = position_bin(F.col("ref_start"), width)
    # Stored, as it is used three times: a row per stretch and quality.
    lists = stored(solid.groupBy(*KEYS, first.alias("stretch"), "mapq").agg(F.min(best).alias("_best")), "lists")
    grid = lists.select(*KEYS, "stretch").distinct().join(lists.select(*KEYS, "mapq").distinct(), KEYS)
    before = Window.partitionBy(*KEYS, "mapq").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carry = grid.join(lists, [*KEYS, "stretch", "mapq"], "left").withColumn("_best", F.min("_best").over(before)).where("_best is not null")
    carry = carry.select(*KEYS, "mapq", "stretch", *[F.col("_best")[c].alias(c) for c in ("ref_start", "block_seq", *rest)])

    takes_part = F.col("stretch") == first
    for has in known(rows):
        takes_part = takes_part & has
    given = rows.withColumns({"_kind": F.when(takes_part, 1).otherwise(2), "_far": F.lit(0).cast("bigint")})
    carry = carry.withColumns({"_kind": F.lit(0), "_far": F.col("ref_end")})
    same = ["cell", "stretch", *KEYS]
    # Carried ones come first, the farthest before the others; then rows in order.
    order = [*same, F.least("_kind", F.lit(1)), F.col("_far").desc(), "ref_start", "block_seq", "ref_end", "asm_chrom", "asm_start", "asm_end", "strand", "mapq"]
    passed = given.unionByName(carry, allowMissingColumns=True).withColumn("cell", cell).repartition(parts, "cell").sortWithinPartitions(*order).drop("_far")
    index = [c.split()[0] for c in _INDEX.split(", ")]
    kept = [c for c in passed.columns if c not in ("cigar", "_kind", *index)]
    kind = lambda c: passed.schema[c].dataType.simpleString()
    before = ", ".join(f"{c}:{kind(c)}" for c in _BEFORE)
    out_kind = f"{', '.join(f'`{c}` {kind(c)}' for c in kept)}, {_INDEX}, gaps array<struct<over:int,upto:int,{before}>>"

    def pass_stretches(batches):
        rows = _Rows(batches, names, same)
        for base, fresh in rows:
            quality, reach, start, part = (rows.numbers(c)[base:] for c in ("mapq", "ref_end", "ref_start", "_kind"))
            found, bounds, blocks_here = [], [0], []
            for i, (new, own, upto, at, is_block) in enumerate(zip(fresh, quality, reach, start, part), base):
                if new:
                    rows.front = Frontier()
                if is_block:
                    if is_block == 1:
                        # What Frontier.before gives, without a generator for each row.
                        over = None
                        for level, far, prev in rows.front.items:
                            if far <= at:
                                found.append((prev, over, level if level < own else own))
                            if level >= own:
                                break
                            over = level
                    blocks_here.append(i)
                    bounds.append(len(found))
                if is_block < 2:
                    rows.front.add(own, upto, i)
            if not blocks_here:
                continue
            prevs, overs, uptos = zip(*found) if found else ((), (), ())
            fields = [pa.array(overs, pa.int32()), pa.array(uptos, pa.int32()), *rows.take(prevs, _BEFORE)]
            gaps = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, ["over", "upto", *_BEFORE]))
            own = rows.take(blocks_here, [*kept, "cigar", *index[:4]])
            here = dict(zip([*kept, "cigar", *index[:4]], own))
            made = short_index(here["cigar"], pc.subtract(here["ref_end"], here["ref_start"]))
            numbers = [pc.if_else(here["cigar"].is_valid(), made[c], here[c]) if c in here else made[c] for c in index]
            yield pa.RecordBatch.from_arrays([*(here[c] for c in kept), *numbers, gaps], [*kept, *index, "gaps"])

    names = passed.columns
    return passed.mapInArrow(pass_stretches, out_kind)
