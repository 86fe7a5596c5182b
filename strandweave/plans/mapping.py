"""Reference windows to assembly coordinates, and the SV events between blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import cigar as C
from strandweave.functions import events as E
from strandweave.functions.regions import window_status
from strandweave.operators.cigar_index import lookup_offsets
from strandweave.operators.intervals import merge_dealt
from strandweave.operators.overlap import overlap_join, position_bin
from strandweave.operators.quality_gaps import FLANK, KEYS, RUN_ROWS, predecessors
from strandweave.operators.scan import DEFAULT_BIN, DEFAULT_SPLIT, running
from strandweave.sources import paf, writers
from strandweave.sources.lookup import BIN, BUCKETS, Lookup, following, write_lookup

JOIN_BIN = 65_536

ASSEMBLY = KEYS
HITS = ["region_id", "sample_id", "hap", "block_start", "block_seq", "kind", "ref_chrom", "ref_start",
        "ref_end", "asm_chrom", "asm_start", "asm_end", "strand", "mapq", "event_type",
        "ref_gap_size", "asm_gap_size"]


def build_mapping(
    spark: SparkSession, pafs: Sequence[str], out: str, sample_id: str = "", hap: str = "",
    bin_width: int = BIN, buckets: int = BUCKETS,
) -> DataFrame:
    """PAF files to the stored layout, its BED form and the lookup; returns the stored blocks.

    Under ``out``: ``blocks`` with their CIGAR text, ``bed``, and ``lookup``,
    which ``open_lookup`` gives to ``map_regions``, ``translate`` and the rest.
    """
    blocks = paf.read_paf(spark, pafs, sample_id, hap)
    writers.write_blocks(blocks, f"{out}/blocks")
    kept = paf.read_blocks(spark, f"{out}/blocks")
    writers.write_mapping_bed(kept, f"{out}/bed")
    named = kept.withColumns({"sample_id": F.lit(sample_id), "hap": F.lit(hap)})  # a folder cannot be named ""
    build_lookup(named, f"{out}/lookup", bin_width, buckets)
    return kept


def build_lookup(blocks: DataFrame, path: str, bin_width: int = BIN, buckets: int = BUCKETS, run_rows: int = RUN_ROWS) -> Lookup:
    """Blocks of any number of assemblies to the stored lookup: blocks, gaps of every threshold, CIGAR entries; ``write_lookup`` says the rest."""
    return write_lookup(blocks, path, bin_width, buckets, run_rows)


def with_predecessor(
    blocks: DataFrame, bin_width: int = DEFAULT_BIN, split_rows: int = DEFAULT_SPLIT
) -> DataFrame:
    """Adds ``prev``: the earlier block reaching farthest, the first of them on ties.

    Order is ``(ref_start, block_seq)``; the remaining columns only settle rows
    that carry the same number. CIGARs do not take part.
    """
    return _with_predecessors(blocks, [(None, "prev")], bin_width, split_rows)


def _with_predecessors(
    blocks: DataFrame, levels: Sequence[tuple[int | None, str]], bin_width: int, split_rows: int
) -> DataFrame:
    """For each ``(min_mapq, name)`` the predecessor among the blocks of that quality (None: among all)."""
    slim = blocks.select(*ASSEMBLY, "block_seq", *FLANK)
    rank = F.struct(
        (-F.col("ref_end")).alias("far"), "ref_start", "block_seq", "asm_chrom", "asm_start",
        "asm_end", "strand", "mapq", "ref_end",
    )
    order = ["ref_start", "block_seq", "ref_end", "asm_chrom", "asm_start", "asm_end", "strand", "mapq"]
    return running(
        slim, ASSEMBLY, order, [rank if m is None else F.when(F.col("mapq") >= m, rank) for m, _ in levels],
        [name for _, name in levels], F.min, bin_width=bin_width, tie="block_seq", split_rows=split_rows,
    )


def sv_gaps(
    blocks: DataFrame,
    min_mapq: int | Sequence[int] = 0,
    bin_width: int = DEFAULT_BIN,
    split_rows: int = DEFAULT_SPLIT,
) -> DataFrame:
    """Every gap event of every assembly.

    Low-quality blocks are removed first, because that changes which gaps exist.
    With several thresholds the events of each are found in one job and carry
    their ``min_mapq``. A window later needs only those gaps whose both flanks
    it overlaps; a gap is never clipped by the window.
    """
    if isinstance(min_mapq, int):
        found = with_predecessor(blocks.filter(F.col("mapq") >= min_mapq), bin_width, split_rows)
        found = found.withColumn("min_mapq", F.lit(min_mapq))
    else:
        levels = [(m, f"prev_{i}") for i, m in enumerate(sorted(set(min_mapq)))]
        found = _with_predecessors(blocks.filter(F.col("mapq") >= levels[0][0]), levels, bin_width, split_rows)
        each = F.array(*[F.struct(F.lit(m).alias("min_mapq"), F.col(name).alias("prev")) for m, name in levels])
        found = found.select(*ASSEMBLY, "block_seq", *FLANK, F.explode(each).alias("at")).select("*", "at.*")
        found = found.filter(F.col("min_mapq") <= F.col("mapq"))
    nxt = F.struct(*FLANK)
    gaps = found.filter(F.col("prev").isNotNull() & E.is_gap(F.col("prev"), nxt))
    return gaps.select(
        "sample_id", "hap", "ref_chrom", "min_mapq",
        F.col("ref_start").alias("block_start"), "block_seq",
        E.gap_record(F.col("prev"), nxt).alias("g"),
    ).select("sample_id", "hap", "ref_chrom", "min_mapq", "block_start", "block_seq", "g.*")


def quality_gaps(blocks: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Every gap event with the thresholds at which it exists: above ``over`` (null: any) up to ``upto``.

    One pass over the blocks, however many thresholds are asked for later.
    """
    found = predecessors(blocks, ASSEMBLY, FLANK, run_rows)
    gaps = found.where(E.is_gap(F.col("prev"), F.col("nxt")))
    return gaps.select(
        *ASSEMBLY, "over", "upto", F.col("nxt.ref_start").alias("block_start"), "block_seq",
        E.gap_record(F.col("prev"), F.col("nxt")).alias("g"),
    ).select(*ASSEMBLY, "over", "upto", "block_start", "block_seq", "g.*")


def _windows(regions: DataFrame, min_mapq: int = 0) -> DataFrame:
    """Windows that are not empty; a ``min_mapq`` of their own goes before the common one."""
    level = F.coalesce("min_mapq", F.lit(min_mapq)) if "min_mapq" in regions.columns else F.lit(min_mapq)
    return regions.filter(F.col("end") > F.col("start")).select(
        "region_id", "sample_id", F.col("chrom").alias("ref_chrom"),
        F.col("start").alias("ws"), F.col("end").alias("we"), level.alias("level"),
    )


def clipped_blocks(regions: DataFrame, blocks: DataFrame, bin_width: int = JOIN_BIN) -> DataFrame:
    """Window-overlapping blocks with the overlap as block offsets ``lo, hi``."""
    pairs = overlap_join(
        _windows(regions).drop("level"), blocks, ["sample_id", "ref_chrom"], ("ws", "we"),
        ("ref_start", "ref_end"), bin_width,
    )
    return _overlap(pairs)


def _overlap(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn(
        "lo", F.greatest("ws", "ref_start") - F.col("ref_start")
    ).withColumn("hi", F.least("we", "ref_end") - F.col("ref_start"))


def _stored_hits(regions: DataFrame, lookup: Lookup, min_mapq: int, aligned: bool = True, gaps: bool = True) -> DataFrame:
    """Alignments and gap events of the windows from one join with the stored blocks.

    A block that lies in its window needs nothing but what it stores. A
    window's edges are looked up in the CIGAR: among the block's own operations, or
    for a long CIGAR in the table of its entries.
    """
    windows = _windows(regions, min_mapq)
    same, block_start = ["region_id", "sample_id", "hap"], F.col("ref_start").alias("block_start")
    index = ["block_no", "n_ops", "whole_lo", "whole_hi", "asm_total", "sizes", "codes"] if aligned else []
    rows = lookup.table("blocks").select(*ASSEMBLY, "cell", "stretch", "block_seq", *FLANK, *index, *(["gaps"] if gaps else []))
    if not aligned:
        each = lookup.meet(windows, rows.where(F.size("gaps") > 0)).withColumn("p", F.explode(_seen()))
        event = E.gap_record(F.col("p"), following()).alias("g")
        return each.select(*same, block_start, "block_seq", F.lit(0).alias("kind"), "ref_chrom", event).select(*HITS[:7], "g.*").select(*HITS)
    hit = (F.col("ref_end") > F.col("ref_start")) & (F.col("ref_end") > 0) & (F.col("ref_end") > F.col("ws")) & (F.col("mapq") >= F.col("level"))
    edge = (F.col("n_ops") > 0) & ((F.col("lo") > 0) | (F.col("hi") < F.col("ref_end") - F.col("ref_start")))

    def met(some: DataFrame) -> DataFrame:
        pairs = lookup.meet(windows, some).withColumn("hit", F.coalesce(hit, F.lit(False)))
        return _overlap(pairs if gaps else pairs.where("hit"))

    entry = {"at": F.col("ref_start"), "asm": F.lit(0).cast("bigint"), "sizes": F.col("sizes"), "codes": F.col("codes")}
    own = {f"{side}_{c}": of for side in ("lo", "hi") for c, of in entry.items()}
    if lookup.has_long:
        pairs = met(rows.where("block_no < 0")).withColumns(own)
        far = met(rows.where("block_no >= 0"))
        cut = far.where(F.col("hit") & edge)
        for side, point in (("lo", F.col("lo")), ("hi", F.col("hi") - 1)):
            asked = cut.withColumn("_at", F.col("ref_start") + point)
            asked = lookup.dealt(asked.withColumn("bin", position_bin(F.col("_at"), lookup.bin_width)))
            entries = lookup.table("ops").select("sample_id", "ref_chrom", "bin", "block_no", "entry_start", "entry_end", "asm", "sizes", "codes").withColumnsRenamed(
                {c: f"_{c}" for c in ("sample_id", "ref_chrom", "bin", "block_no", "sizes", "codes")})
            on = [F.col(c) == F.col(f"_{c}") for c in ("bin", "sample_id", "ref_chrom", "block_no")]
            found = asked.join(entries, [*on, F.col("_at") >= F.col("entry_start"), F.col("_at") < F.col("entry_end")], "left")
            got = {"at": F.col("entry_start"), "asm": F.col("asm"), "sizes": F.col("_sizes"), "codes": F.col("_codes")}
            cut = found.withColumns({f"{side}_{c}": of for c, of in got.items()}).select(*cut.columns, *[f"{side}_{c}" for c in got])
        pairs = pairs.unionByName(cut).unionByName(far.where(~(F.col("hit") & edge)), allowMissingColumns=True)
    else:
        pairs = met(rows).withColumns(own)

    def inside(side: str) -> Column:
        return C.entry_offset(
            F.col(f"{side}_sizes"), F.col(f"{side}_codes"), F.col(f"{side}_at") - F.col("ref_start"), F.col(f"{side}_asm"), F.col(side), side == "lo").alias(side)

    # The row of one keeps the folds from being copied into every filter above.
    pairs = pairs.withColumn("cut", F.col("hit") & edge)
    pairs = pairs.withColumn("q", F.explode(F.array(F.when(F.col("cut"), F.struct(inside("lo"), inside("hi"))))))
    at = {side: F.when(F.col("q").isNotNull(), F.coalesce(f"q.{side}", "asm_total")).when(F.col("n_ops") == 0, F.col(side)).otherwise(F.col(f"whole_{side}")) for side in ("lo", "hi")}
    pairs = pairs.withColumns({f"q_{side}": of for side, of in at.items()})
    place = C.orient(F.col("q_lo"), F.col("q_hi"), F.col("strand"), F.col("asm_start"), F.col("asm_end"))
    none = F.lit(None).cast("bigint")
    alignment = {
        "ref_start": F.col("ref_start") + F.col("lo"), "ref_end": F.col("ref_start") + F.col("hi"), "asm_chrom": F.col("asm_chrom"),
        "asm_start": place["start"], "asm_end": place["end"], "strand": F.col("strand"), "mapq": F.col("mapq"),
        "event_type": F.lit("alignment"), "ref_gap_size": none, "asm_gap_size": none,
    }
    if not gaps:
        return pairs.select(*same, block_start, "block_seq", F.lit(1).alias("kind"), "ref_chrom", *[of.alias(c) for c, of in alignment.items()])
    # An item is a gap's previous block, or null for the alignment itself.
    itself = F.when(F.col("hit"), F.array(F.lit(None))).otherwise(F.array())
    each = pairs.withColumn("p", F.explode(F.concat(itself.cast(rows.schema["gaps"].dataType), _seen())))
    event, is_hit = E.gap_record(F.col("p"), following()), F.col("p").isNull()
    fields = [F.when(is_hit, of).otherwise(event[c]).alias(c) for c, of in alignment.items()]
    return each.select(*same, block_start, "block_seq", is_hit.cast("int").alias("kind"), "ref_chrom", *fields)


def _seen() -> Column:
    """The previous blocks of those gaps before a stored block that its window sees at its level."""
    return F.filter("gaps", lambda p: (p["ref_end"] > F.col("ws")) & (F.col("ref_start") < F.col("we")) & (F.col("level") <= p["upto"])
                    & (p["over"].isNull() | (F.col("level") > p["over"])))


def map_alignments(
    regions: DataFrame,
    blocks: DataFrame | Lookup,
    bin_width: int = JOIN_BIN,
    ops: DataFrame | None = None,
    block_key: Sequence[str] = ("sample_id", "hap", "block_seq"),
    min_mapq: int = 0,
) -> DataFrame:
    """Projected alignments of each window.

    With a stored lookup no CIGAR text takes part. Plain blocks carry their
    CIGARs to the windows, where a batch of them is parsed at once; with
    ``ops``, the result of ``index_cigars`` or ``explode_cigars``, offsets are
    looked up there.
    ``regions`` may have a ``min_mapq`` of their own.
    """
    key = list(block_key)
    slim = list(dict.fromkeys([*ASSEMBLY, "block_seq", *FLANK, *(key if ops is not None else [])]))
    placed = lambda lo, hi: C.orient(lo, hi, F.col("strand"), F.col("asm_start"), F.col("asm_end"))

    if isinstance(blocks, Lookup):
        return _stored_hits(regions, blocks, min_mapq, gaps=False)
    kept = blocks.select(*slim, *([] if ops is not None else ["cigar"]))
    windows = _windows(regions, min_mapq)
    pairs = overlap_join(windows, kept, ["sample_id", "ref_chrom"], ("ws", "we"), ("ref_start", "ref_end"), bin_width)
    pairs = _overlap(pairs.where(F.col("mapq") >= F.col("level")).drop("level"))
    if ops is None:
        off = pairs.withColumn("off", C.block_offsets(F.col("cigar"), F.col("lo"), F.col("hi")))
        hits = off.withColumn("asm", placed(F.col("off.lo"), F.col("off.hi"))).drop("off", "cigar")
    else:
        hits = lookup_offsets(pairs, ops, key).withColumn("asm", placed(F.col("q_lo"), F.col("q_hi")))
    none = F.lit(None).cast("bigint")
    return hits.select(
        "region_id", "sample_id", "hap", F.col("ref_start").alias("block_start"), "block_seq",
        F.lit(1).alias("kind"), "ref_chrom",
        (F.col("ref_start") + F.col("lo")).alias("ref_start"),
        (F.col("ref_start") + F.col("hi")).alias("ref_end"),
        "asm_chrom", F.col("asm.start").alias("asm_start"), F.col("asm.end").alias("asm_end"),
        "strand", "mapq", F.lit("alignment").alias("event_type"),
        none.alias("ref_gap_size"), none.alias("asm_gap_size"),
    )


def gaps_in_windows(regions: DataFrame, gaps: DataFrame | Lookup, bin_width: int = JOIN_BIN, min_mapq: int = 0) -> DataFrame:
    """Gap events both of whose flanking blocks overlap the window.

    That is ``window start < previous end`` and ``window end > next start``: the
    window holds the last base of the previous block and passes the gap's end.
    Gaps that carry a range of thresholds, as a lookup's do, count for windows
    whose ``min_mapq`` lies in it.
    """
    if isinstance(gaps, Lookup):
        return _stored_hits(regions, gaps, min_mapq, aligned=False)
    last = gaps.withColumn("__at", F.col("ref_start") - 1).withColumn("__to", F.col("ref_start"))
    pairs = overlap_join(_windows(regions, min_mapq), last, ["sample_id", "ref_chrom"], ("ws", "we"), ("__at", "__to"), bin_width)
    if "upto" in pairs.columns:
        pairs = pairs.filter((F.col("level") <= F.col("upto")) & (F.col("over").isNull() | (F.col("level") > F.col("over"))))
    return pairs.filter(F.col("we") > F.col("ref_end")).withColumn("kind", F.lit(0)).select(*HITS)


def map_regions(
    regions: DataFrame,
    blocks: DataFrame | Lookup,
    min_mapq: int = 0,
    gaps: DataFrame | None = None,
    bin_width: int = JOIN_BIN,
    **alignment_options,
) -> DataFrame:
    """Alignments and gap events of each window, on every haplotype of its sample.

    ``regions(region_id, sample_id, chrom, start, end)``, each with its own
    ``min_mapq`` if there is such a column, against a stored lookup or blocks.
    Pass stored ``gaps`` of the same ``min_mapq`` to skip finding them again.
    Sort by ``writers.HIT_ORDER`` for result order: by block, the gap before it
    first.
    """
    if isinstance(blocks, Lookup):
        return _stored_hits(regions, blocks, min_mapq)
    if gaps is not None:
        events = gaps.filter(F.col("min_mapq") == min_mapq) if "min_mapq" in gaps.columns else gaps
    elif "min_mapq" in regions.columns:
        events = quality_gaps(blocks)
    else:
        events = sv_gaps(blocks, min_mapq)
    found = map_alignments(regions, blocks, bin_width, min_mapq=min_mapq, **alignment_options)
    return found.unionByName(gaps_in_windows(regions, events, bin_width, min_mapq))


def translated_intervals(
    regions: DataFrame, blocks: DataFrame | Lookup, min_mapq: int = 0, limit: int | None = None, **options
) -> DataFrame:
    """Merged assembly intervals of each valid window per haplotype, contig and strand."""
    valid = regions.filter(window_status(F.col("start"), F.col("end"), limit) == "ok")
    found = map_alignments(valid, blocks, min_mapq=min_mapq, **options)
    solid = found.filter((F.col("asm_chrom") != "") & (F.col("asm_end") > F.col("asm_start")))
    return merge_dealt(solid, ["region_id", "sample_id", "hap", "asm_chrom", "strand"], ["region_id"], "asm_start", "asm_end")


def translate(regions: DataFrame, blocks: DataFrame | Lookup, min_mapq: int = 0, limit: int | None = None, **options) -> DataFrame:
    """``translated_intervals`` with a ``status`` and a row for every window.

    A window without an interval has one row of nulls, whose status says why:
    ``invalid``, ``empty``, ``unmapped``, or ``too_large`` if a limit is set.
    """
    found = translated_intervals(regions, blocks, min_mapq, limit, **options)
    asked = regions.select("region_id", "sample_id", window_status(F.col("start"), F.col("end"), limit).alias("status"))
    every = asked.join(found, ["region_id", "sample_id"], "left")
    lost = (F.col("status") == "ok") & F.col("asm_chrom").isNull()
    return every.withColumn("status", F.when(lost, "unmapped").otherwise(F.col("status")))


def sv_annotations(regions: DataFrame, blocks: DataFrame | Lookup, **options) -> DataFrame:
    """Gap events of each window with a display label such as ``hap1: Deletion``."""
    label = F.initcap("event_type")
    label = F.when(F.col("hap") == "", label).otherwise(F.concat("hap", F.lit(": "), label))
    found = gaps_in_windows(regions, blocks if isinstance(blocks, Lookup) else sv_gaps(blocks), **options)
    return found.select(
        "region_id", "sample_id", "hap", "event_type", "ref_start", "ref_end", "asm_start", "asm_end",
        F.col("ref_gap_size").alias("gap_size"), label.alias("label"),
    )


def assembly_intervals(hits: DataFrame, keys: Sequence[str], deal: Sequence[str]) -> DataFrame:
    """Merged assembly intervals ``keys, asm_chrom, start, end``, ignoring strand, dealt by ``deal``, some of the ``keys``."""
    aligned = hits.filter(F.col("event_type") == "alignment")
    lo, hi = F.least("asm_start", "asm_end"), F.greatest("asm_start", "asm_end")
    return merge_dealt(aligned.withColumn("lo", lo).withColumn("hi", hi), [*keys, "asm_chrom"], deal, "lo", "hi")


def region_texts(of: Column) -> Column:
    """The intervals of a group for which ``of`` holds, as text in contig order."""
    item = F.when(of, F.struct("asm_chrom", "start", "end"))
    text = lambda x: F.concat(x["asm_chrom"], F.lit(":"), x["start"], F.lit("-"), x["end"])
    return F.transform(F.array_sort(F.collect_list(item)), text)


def assembly_regions(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merged assembly intervals per contig, ignoring strand, as text in contig order.

    ``keys`` name one query window each.

    ``keys, regions``: one list per key; it is empty for no key, so left-join it.
    """
    return assembly_intervals(hits, keys, keys).groupBy(*keys).agg(region_texts(F.lit(True)).alias("regions"))
