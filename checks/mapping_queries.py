"""Blocks, windows, CIGARs and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks import views as V
from checks.registry import check
from checks.views import ctes
from strandweave.functions import cigar as C
from strandweave.functions import events as E
from strandweave.functions import regions as R
from strandweave.operators import intervals as I
from strandweave.operators.cigar_index import explode_cigars, index_cigars, lookup_offsets
from strandweave.plans import mapping as M
from strandweave.sources import writers

BIN = 256
HITS = ", ".join(M.HITS)
HITS_TEXT = HITS.replace("ref_gap_size, asm_gap_size", "CAST(ref_gap_size AS VARCHAR) AS ref_gap_size, CAST(asm_gap_size AS VARCHAR) AS asm_gap_size")


def _text(df, *names):
    """Columns that may be null as text: null whole numbers have no one pandas type."""
    return df.withColumns({c: F.col(c).cast("string") for c in names})


def _named(df):
    """Interval columns renamed so that the SQL needs no quoting."""
    return df.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


def _walked(pairs):
    off = pairs.withColumn("o", C.block_offsets(F.col("cigar"), F.col("lo"), F.col("hi")))
    at = C.orient(F.col("o.lo"), F.col("o.hi"), F.col("strand"), F.col("asm_start"), F.col("asm_end"))
    return off.withColumn("q", at).select(
        "region_id", "block_id", F.col("q.start").alias("q_start"), F.col("q.end").alias("q_end")
    )


# --- overlap, clipping, filters -------------------------------------------------

@check("p1_window_overlap", f"""{ctes('blocks', 'windows')}
SELECT w.region_id, b.hap, b.ref_start, b.ref_end, b.asm_start FROM windows w
JOIN blocks b ON w.chrom = b.ref_chrom AND b.ref_start < w.we AND b.ref_end > w.ws""")
def p1(spark, d):
    pairs = M.clipped_blocks(V.windows(spark, d), V.blocks(spark, d), BIN)
    return pairs.select("region_id", "hap", "ref_start", "ref_end", "asm_start")


@check("j1_region_block_join", f"""{ctes('blocks', 'windows')}, {S.kept(0)}, {S.PAIRS}
SELECT region_id, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(hi - lo) AS BIGINT) AS bases,
  MIN(block_id) AS first_block FROM pairs GROUP BY region_id""")
def j1(spark, d):
    pairs = M.clipped_blocks(V.windows(spark, d), V.blocks(spark, d), BIN)
    return pairs.groupBy("region_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("hi") - F.col("lo")).alias("bases"),
        F.min("block_id").alias("first_block"),
    )


@check("p2_min_mapq_gaps", f"""{ctes('blocks')}, {S.kept(40)}, {S.PREV}, {S.PFIELDS}, {S.GAPS}
SELECT hap, ref_chrom, ref_start, ref_end, event_type, mapq FROM gaps""")
def p2(spark, d):
    return M.sv_gaps(V.blocks(spark, d), 40, bin_width=65_536).select(
        "hap", "ref_chrom", "ref_start", "ref_end", "event_type", "mapq"
    )


@check("p2_many_thresholds", f"""{ctes('blocks')}, levels AS (SELECT UNNEST([0, 20, 50]) AS min_mapq),
kept AS (SELECT b.* EXCLUDE (hap), b.hap || ':' || l.min_mapq AS hap FROM blocks b JOIN levels l ON b.mapq >= l.min_mapq),
{S.PREV}, {S.PFIELDS}, {S.GAPS}
SELECT SPLIT_PART(hap, ':', 1) AS hap, CAST(SPLIT_PART(hap, ':', 2) AS INTEGER) AS min_mapq, event_type,
  CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(ref_gap_size) AS BIGINT) AS bases FROM gaps GROUP BY ALL""")
def p2_many(spark, d):
    gaps = M.sv_gaps(V.blocks(spark, d), [0, 20, 50], bin_width=65_536)
    return gaps.groupBy("hap", "min_mapq", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ref_gap_size").alias("bases")
    )


@check("p3_clip", f"""{ctes('blocks', 'windows')}, {S.kept(0)}, {S.PAIRS}
SELECT region_id, block_id, ref_start + lo AS clip_start, ref_start + hi AS clip_end FROM pairs WHERE hi > lo""")
def p3(spark, d):
    pairs = M.clipped_blocks(V.windows(spark, d), V.blocks(spark, d), BIN).filter("hi > lo")
    return pairs.select(
        "region_id", "block_id", (F.col("ref_start") + F.col("lo")).alias("clip_start"),
        (F.col("ref_start") + F.col("hi")).alias("clip_end"),
    )


@check("p4_linear_projection", f"""{ctes('blocks', 'windows')}, {S.kept(0)}, {S.PAIRS}
SELECT region_id, block_id, CASE WHEN strand = '+' THEN asm_start + lo ELSE asm_end - hi END AS q_start,
  CASE WHEN strand = '+' THEN asm_start + hi ELSE asm_end - lo END AS q_end FROM pairs""")
def p4(spark, d):
    plain = V.blocks(spark, d).withColumn("cigar", F.lit(""))
    pairs = M.clipped_blocks(V.windows(spark, d), plain, BIN)
    return _walked(pairs)


@check("p5_solid_alignments", f"""{ctes('blocks', 'windows')}, {S.kept(0)}, {S.PAIRS}, {S.PROJECTED}
SELECT hap, asm_chrom, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(asm_end - asm_start) AS BIGINT) AS bases
FROM aligned WHERE asm_end > asm_start GROUP BY ALL""")
def p5(spark, d):
    hits = M.map_alignments(V.windows(spark, d), V.blocks(spark, d), BIN)
    solid = hits.filter((F.col("event_type") == "alignment") & (F.col("asm_chrom") != "")
                        & (F.col("asm_end") > F.col("asm_start")))
    return solid.groupBy("hap", "asm_chrom").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("asm_end") - F.col("asm_start")).alias("bases")
    )


# --- CIGARs -----------------------------------------------------------------------

@check("f4_explode_cigar", f"""{ctes('blocks')}, {S.OPS} SELECT block_id, op_idx, op, len FROM ops""")
def f4(spark, d):
    ops = V.blocks(spark, d).select("block_id", F.posexplode(C.cigar_ops(F.col("cigar"))).alias("op_idx", "x"))
    return ops.select("block_id", "op_idx", "x.op", "x.len")


@check("f5_consumes", f"""{ctes('blocks')}, {S.OPS} SELECT op, op IN ('M','D','N','X','=') AS on_ref,
  op IN ('M','I','S','X','=') AS on_asm, CAST(SUM(len) AS BIGINT) AS bases FROM ops GROUP BY ALL""")
def f5(spark, d):
    ops = V.blocks(spark, d).select(F.explode(C.cigar_ops(F.col("cigar"))).alias("x")).select("x.*")
    return ops.groupBy(
        "op", C.consumes_ref(F.col("op")).alias("on_ref"), C.consumes_asm(F.col("op")).alias("on_asm")
    ).agg(F.sum("len").alias("bases"))


@check("w4_cigar_prefix_sums", f"""{ctes('blocks')}, {S.OPS} SELECT block_id, op_idx, op, len,
  ref_hi - CASE WHEN op IN ('M','D','N','X','=') THEN len ELSE 0 END AS ref_lo, ref_hi,
  asm_hi - CASE WHEN op IN ('M','I','S','X','=') THEN len ELSE 0 END AS asm_lo, asm_hi FROM ops""")
def w4(spark, d):
    return explode_cigars(V.blocks(spark, d), ["block_id"])


@check("a8_cigar_totals", f"""{ctes('blocks')}, {S.OPS}
SELECT block_id, MAX(ref_hi) AS ref_len, MAX(asm_hi) AS asm_len FROM ops GROUP BY block_id""")
def a8(spark, d):
    return V.blocks(spark, d).select("block_id", C.cigar_totals(F.col("cigar")).alias("t")).select("block_id", "t.*")


_PROJECTION = f"""{ctes('blocks', 'windows')}, {S.kept(0)}, {S.PAIRS}, {S.OPS},
starts AS (SELECT p.region_id, p.block_id, ANY_VALUE(o.asm_hi - CASE WHEN o.op = 'M' THEN o.ref_hi - p.lo ELSE 0 END) AS q
  FROM pairs p JOIN ops o ON p.block_id = o.block_id AND o.op IN ('M', 'D') AND o.ref_hi - o.len <= p.lo AND p.lo < o.ref_hi
  GROUP BY ALL),
ends AS (SELECT p.region_id, p.block_id, ANY_VALUE(o.asm_hi - CASE WHEN o.op = 'M' THEN o.ref_hi - p.hi ELSE 0 END) AS q
  FROM pairs p JOIN ops o ON p.block_id = o.block_id AND o.op IN ('M', 'D') AND o.ref_hi - o.len < p.hi AND p.hi <= o.ref_hi
  GROUP BY ALL)
SELECT p.region_id, p.block_id,
  CASE WHEN strand = '+' THEN asm_start + s.q ELSE asm_end - e.q END AS q_start,
  CASE WHEN strand = '+' THEN asm_start + e.q ELSE asm_end - s.q END AS q_end
FROM pairs p JOIN starts s USING (region_id, block_id) JOIN ends e USING (region_id, block_id)"""


@check("f6_project_inline", _PROJECTION)
def f6(spark, d):
    pairs = M.clipped_blocks(V.windows(spark, d), V.blocks(spark, d), BIN)
    return _walked(pairs)


@check("j6_project_indexed", _PROJECTION)
def j6(spark, d):
    blocks = V.blocks(spark, d)
    slim = blocks.drop("cigar")
    pairs = M.clipped_blocks(V.windows(spark, d), slim, BIN)
    found = lookup_offsets(pairs, index_cigars(blocks, ["block_id"], bin_width=64), ["block_id"], bin_width=64)
    at = C.orient(F.col("q_lo"), F.col("q_hi"), F.col("strand"), F.col("asm_start"), F.col("asm_end"))
    return found.withColumn("q", at).select(
        "region_id", "block_id", F.col("q.start").alias("q_start"), F.col("q.end").alias("q_end")
    )


# --- predecessor and events ---------------------------------------------------------

@check("w1_high_water_predecessor", f"""{ctes('blocks')}, {S.kept(0)}, {S.PREV}
SELECT hap, ref_chrom, ref_start, block_seq, CAST(p[1] AS VARCHAR) AS prev_start, CAST(p[2] AS VARCHAR) AS prev_end, p[3] AS prev_contig, CAST(p[4] AS VARCHAR) AS prev_asm
FROM prev""")
def w1(spark, d):
    prev = M.with_predecessor(V.blocks(spark, d), bin_width=65_536)
    flat = prev.select(
        "hap", "ref_chrom", "ref_start", "block_seq", F.col("prev.ref_start").alias("prev_start"),
        F.col("prev.ref_end").alias("prev_end"), F.col("prev.asm_chrom").alias("prev_contig"),
        F.col("prev.asm_start").alias("prev_asm"),
    )
    return _text(flat, "prev_start", "prev_end", "prev_asm")


@check("w1_crowded_bins", f"""{ctes('blocks')}, kept AS (SELECT * REPLACE (ref_start // 4000 AS ref_start, ref_end // 4000 + 1 AS ref_end) FROM blocks), {S.PREV}
SELECT hap, ref_chrom, ref_start, block_seq, CAST(p[1] AS VARCHAR) AS prev_start, CAST(p[2] AS VARCHAR) AS prev_end, p[3] AS prev_contig, CAST(p[4] AS VARCHAR) AS prev_asm
FROM prev""")
def w1_crowded(spark, d):
    """The same on coordinates squeezed until most blocks share their start with others."""
    small = lambda c: F.floor(F.col(c) / 4000).cast("bigint")
    tight = V.blocks(spark, d).withColumn("ref_end", small("ref_end") + 1).withColumn("ref_start", small("ref_start"))
    prev = M.with_predecessor(tight, bin_width=64, split_rows=500)
    flat = prev.select(
        "hap", "ref_chrom", "ref_start", "block_seq", F.col("prev.ref_start").alias("prev_start"),
        F.col("prev.ref_end").alias("prev_end"), F.col("prev.asm_chrom").alias("prev_contig"),
        F.col("prev.asm_start").alias("prev_asm"),
    )
    return _text(flat, "prev_start", "prev_end", "prev_asm")


@check("f7_classify_gap", f"""{ctes('blocks')}, {S.kept(0)}, {S.PREV}, {S.PFIELDS}, {S.GAPS}
SELECT event_type, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(ref_gap_size) AS BIGINT) AS ref_bases,
  CAST(CAST(SUM(asm_gap_size) AS BIGINT) AS VARCHAR) AS asm_bases FROM gaps GROUP BY event_type""")
def f7(spark, d):
    return M.sv_gaps(V.blocks(spark, d), bin_width=65_536).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ref_gap_size").alias("ref_bases"),
        F.sum("asm_gap_size").cast("string").alias("asm_bases"),
    )


@check("f8_junction_events", f"""{ctes('blocks')}, {S.kept(0)}, {S.PREV}, {S.PFIELDS}
SELECT hap, ref_chrom, ref_start, block_seq,
  p_ac <> asm_chrom OR p_st <> strand OR COALESCE(asm_gap, 0) <> 0 AS is_event FROM flat WHERE p_re = ref_start""")
def f8(spark, d):
    prev = M.with_predecessor(V.blocks(spark, d), bin_width=65_536)
    touching = prev.filter(F.col("prev.ref_end") == F.col("ref_start"))
    return touching.select(
        "hap", "ref_chrom", "ref_start", "block_seq", E.is_gap(F.col("prev"), F.struct(*M.FLANK)).alias("is_event")
    )


@check("f20_flank_mapq", f"""{ctes('blocks')}, {S.kept(0)}, {S.PREV}, {S.PFIELDS}, {S.GAPS}
SELECT ref_chrom, mapq, CAST(COUNT(*) AS BIGINT) AS n FROM gaps GROUP BY ALL""")
def f20(spark, d):
    return M.sv_gaps(V.blocks(spark, d), bin_width=65_536).groupBy("ref_chrom", "mapq").agg(F.count(F.lit(1)).alias("n"))


@check("q3_sv_gaps", f"""{ctes('blocks')}, {S.kept(0)}, {S.PREV}, {S.PFIELDS}, {S.GAPS}
SELECT * REPLACE (CAST(asm_gap_size AS VARCHAR) AS asm_gap_size) FROM gaps""")
def q3(spark, d):
    return _text(M.sv_gaps(V.blocks(spark, d), bin_width=65_536).drop("min_mapq"), "asm_gap_size")


_HITS = f"""{S.PREV}, {S.PFIELDS}, {S.GAPS}, {S.PAIRS}, {S.PROJECTED}, {S.SEEN_GAPS}"""


@check("q2_map_regions", f"""{ctes('blocks', 'windows')}, {S.kept(0)}, {_HITS}
SELECT {HITS_TEXT} FROM aligned UNION ALL SELECT {HITS_TEXT} FROM seen""")
def q2(spark, d):
    return _text(M.map_regions(V.windows(spark, d), V.lookup(spark, d)), "ref_gap_size", "asm_gap_size")


@check("q2_map_regions_mapq30", f"""{ctes('blocks', 'windows')}, {S.kept(30)}, {_HITS}
SELECT {HITS_TEXT} FROM aligned UNION ALL SELECT {HITS_TEXT} FROM seen""")
def q2_mapq(spark, d):
    """With every CIGAR looked up in the index instead of walked."""
    blocks = V.blocks(spark, d)
    hits = M.map_regions(
        V.windows(spark, d), blocks, 30, bin_width=BIN,
        ops=index_cigars(blocks, ["block_id"]), block_key=["block_id"],
    )
    return _text(hits, "ref_gap_size", "asm_gap_size")


_LEVELS = "windows_of AS (SELECT *, CAST(region_id % 8 * 10 - 5 AS INTEGER) AS level FROM windows)"


@check("q2_mapq_per_window", f"""{ctes('blocks', 'windows')}, {_LEVELS},
levels AS (SELECT DISTINCT level FROM windows_of),
kept AS (SELECT b.* EXCLUDE (hap), b.hap || ':' || l.level AS hap FROM blocks b JOIN levels l ON b.mapq >= l.level),
{S.PREV}, {S.PFIELDS}, {S.GAPS}
SELECT w.region_id, SPLIT_PART(g.hap, ':', 1) AS hap, g.ref_start, g.ref_end, g.event_type, g.asm_start, g.asm_end, g.mapq, 0 AS kind
FROM windows_of w JOIN gaps g ON w.chrom = g.ref_chrom AND g.hap LIKE '%:' || w.level AND g.ref_start > w.ws AND g.ref_end < w.we
UNION ALL SELECT w.region_id, b.hap, GREATEST(b.ref_start, w.ws), LEAST(b.ref_end, w.we), 'alignment', 0, 0, b.mapq, 1
FROM windows_of w JOIN blocks b ON w.chrom = b.ref_chrom AND b.ref_start < w.we AND b.ref_end > w.ws AND b.mapq >= w.level""")
def q2_levels(spark, d):
    """Every window with a threshold of its own, from one lookup."""
    asked = V.windows(spark, d).withColumn("min_mapq", (F.col("region_id") % 8 * 10 - 5).cast("int"))
    hits = M.map_regions(asked, V.lookup(spark, d))
    place = lambda c: F.when(F.col("kind") == 0, F.col(c)).otherwise(F.lit(0)).alias(c)
    return hits.select("region_id", "hap", "ref_start", "ref_end", "event_type", place("asm_start"), place("asm_end"), "mapq", "kind")


@check("u1_union_hits", f"""{ctes('blocks', 'windows')}, {S.kept(0)}, {_HITS}
SELECT event_type, kind, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT {HITS} FROM aligned UNION ALL SELECT {HITS} FROM seen) GROUP BY ALL""")
def u1(spark, d):
    return q2(spark, d).groupBy("event_type", "kind").agg(F.count(F.lit(1)).alias("n"))


@check("j12_both_haplotypes", f"""{ctes('blocks', 'windows')}, {S.kept(0)}, {S.PAIRS}
SELECT region_id, CAST(COUNT(*) FILTER (hap = 'hap1') AS BIGINT) AS n1,
  CAST(COUNT(*) FILTER (hap = 'hap2') AS BIGINT) AS n2 FROM pairs GROUP BY region_id""")
def j12(spark, d):
    pairs = M.clipped_blocks(V.windows(spark, d), V.blocks(spark, d), BIN)
    return pairs.groupBy("region_id").agg(
        F.count_if(F.col("hap") == "hap1").alias("n1"), F.count_if(F.col("hap") == "hap2").alias("n2")
    )


@check("q14_sv_annotations", f"""{ctes('blocks', 'windows')}, {S.kept(0)}, {_HITS}
SELECT region_id, sample_id, hap, event_type, ref_start, ref_end, asm_start, asm_end, ref_gap_size AS gap_size,
  hap || ': ' || UPPER(LEFT(event_type, 1)) || SUBSTRING(event_type, 2) AS label FROM seen""")
def q14(spark, d):
    return M.sv_annotations(V.windows(spark, d), V.lookup(spark, d))


@check("p6_gap_labels", f"""{ctes('blocks', 'windows')}, {S.kept(0)}, {_HITS}
SELECT hap || ': ' || UPPER(LEFT(event_type, 1)) || SUBSTRING(event_type, 2) AS label,
  CAST(COUNT(*) AS BIGINT) AS n FROM seen GROUP BY ALL""")
def p6(spark, d):
    return q14(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# --- sorting ----------------------------------------------------------------------

@check("l1_sorted_blocks", f"""{ctes('blocks')} SELECT ref_chrom, ref_start, block_seq,
  ROW_NUMBER() OVER (ORDER BY ref_chrom, ref_start, block_seq) - 1 AS ord FROM blocks""")
def l1(spark, d):
    return V.numbered(writers.sorted_blocks(V.blocks(spark, d)).select("ref_chrom", "ref_start", "block_seq"))


@check("l2_result_order", f"""{ctes('blocks', 'windows')}, {S.kept(0)}, {_HITS},
every AS (SELECT {HITS} FROM aligned UNION ALL SELECT {HITS} FROM seen)
SELECT region_id, hap, block_start, block_seq, kind, ROW_NUMBER() OVER (ORDER BY region_id, hap, block_start, block_seq, kind) - 1 AS ord FROM every""")
def l2(spark, d):
    return V.numbered(q2(spark, d).orderBy(*writers.HIT_ORDER).select("region_id", "hap", "block_start", "block_seq", "kind"))


@check("a6_longest_block", f"""{ctes('blocks')} SELECT hap, ref_chrom, MAX(ref_end - ref_start) AS max_block_len
FROM blocks GROUP BY ALL""")
def a6(spark, d):
    return I.longest_block(V.blocks(spark, d), ["hap", "ref_chrom"])


# --- interval algebra ----------------------------------------------------------------

@check("w2_merge_strand", f"""{ctes('blocks')}, {S.merged('blocks', 'hap, asm_chrom, strand', 'asm_start', 'asm_end')}
SELECT hap, asm_chrom, strand, start_pos, end_pos FROM isl""")
def w2(spark, d):
    return _named(I.merge_intervals(V.blocks(spark, d), ["hap", "asm_chrom", "strand"], "asm_start", "asm_end", 65_536))


@check("w2_merge_contig", f"""{ctes('blocks')}, {S.merged('blocks', 'hap, asm_chrom', 'asm_start', 'asm_end')}
SELECT hap, asm_chrom, start_pos, end_pos FROM isl""")
def w2_contig(spark, d):
    return _named(I.merge_intervals(V.blocks(spark, d), ["hap", "asm_chrom"], "asm_start", "asm_end", 65_536))


_CLUSTERS = S.merged("blocks", "hap, ref_chrom, asm_chrom, strand", "ref_start", "ref_end", 60)


@check("w3_cluster", f"""{ctes('blocks')}, {_CLUSTERS}
SELECT hap, ref_chrom, asm_chrom, strand, start_pos, end_pos FROM isl""")
def w3(spark, d):
    return _named(_clusters(spark, d)).drop("covered", "pieces")


@check("a7_cluster_score", f"""{ctes('blocks')}, {_CLUSTERS}
SELECT hap, ref_chrom, asm_chrom, strand, start_pos, end_pos, covered, pieces FROM isl""")
def a7(spark, d):
    return _named(_clusters(spark, d))


def _clusters(spark, d):
    return I.cluster_intervals(
        V.blocks(spark, d), ["hap", "ref_chrom", "asm_chrom", "strand"], "ref_start", "ref_end", 60, 65_536
    )


@check("l4_best_cluster", f"""{ctes('blocks')}, {S.merged('blocks', 'hap, ref_chrom, asm_chrom', 'ref_start', 'ref_end', 60)}
SELECT hap, ref_chrom, asm_chrom, start_pos, end_pos, covered, pieces FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY hap, ref_chrom
    ORDER BY covered DESC, end_pos - start_pos, asm_chrom, start_pos) AS rn FROM isl) WHERE rn = 1""")
def l4(spark, d):
    clusters = I.cluster_intervals(V.blocks(spark, d), ["hap", "ref_chrom", "asm_chrom"], "ref_start", "ref_end", 60, 65_536)
    return _named(I.best_cluster(clusters, ["hap", "ref_chrom"]))


@check("a10_bounding_region", f"""{ctes('blocks', 'windows')}, {S.kept(0)}, {S.PAIRS}, {S.PROJECTED},
boxes AS (SELECT region_id, hap, asm_chrom, GREATEST(MIN(LEAST(asm_start, asm_end)), 1) AS start_pos,
  MAX(GREATEST(asm_start, asm_end)) AS end_pos FROM aligned GROUP BY ALL)
SELECT region_id, hap, asm_chrom, start_pos, end_pos FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY region_id, hap ORDER BY asm_chrom) AS rn FROM boxes WHERE end_pos >= start_pos)
WHERE rn = 1""")
def a10(spark, d):
    hits = M.map_alignments(V.windows(spark, d), V.blocks(spark, d), BIN)
    return _named(I.bounding_region(hits, ["region_id", "hap"]))


@check("q4_translate", f"""{ctes('blocks', 'windows')}, {S.kept(0)}, {S.PAIRS}, {S.PROJECTED},
solid AS (SELECT * FROM aligned WHERE asm_end > asm_start),
{S.merged('solid', 'region_id, sample_id, hap, asm_chrom, strand', 'asm_start', 'asm_end')}
SELECT w.region_id, w.sample_id, CASE WHEN asm_chrom IS NULL THEN 'unmapped' ELSE 'ok' END AS status,
  hap, asm_chrom, strand, start_pos, end_pos FROM windows w LEFT JOIN isl USING (region_id)""")
def q4(spark, d):
    return _named(M.translate(V.windows(spark, d), V.lookup(spark, d)))


# --- windows and region text -------------------------------------------------------------

@check("p9_window_status", f"""{ctes('windows')}, odd AS (SELECT region_id, ws - 4000 AS s,
  CASE WHEN region_id % 5 = 0 THEN ws - 4000 WHEN region_id % 5 = 1 THEN we + 3000000 WHEN region_id % 5 = 2 THEN ws - 4100
  ELSE we END AS e FROM windows)
SELECT region_id, CASE WHEN s < 0 OR e < 0 OR e < s THEN 'invalid' WHEN e = s THEN 'empty'
  WHEN e - s > 2000000 THEN 'too_large' ELSE 'ok' END AS status FROM odd""")
def p9(spark, d):
    m = F.col("region_id") % 5
    s = F.col("start") - 4000
    e = F.when(m == 0, s).when(m == 1, F.col("end") + 3000000).when(m == 2, s - 100).otherwise(F.col("end"))
    return V.windows(spark, d).select("region_id", R.window_status(s, e, 2_000_000).alias("status"))


@check("p10_buffered_window", f"""{ctes('windows')}, v AS (SELECT region_id, ws, ws + (we - ws) * (1 + region_id % 3000) AS we,
  CAST(region_id % 8 AS DOUBLE) - 1 + 0.25 AS buf FROM windows),
b AS (SELECT region_id, GREATEST(0, ws - CAST(TRUNC((we - ws) * GREATEST(buf, 0.0)) AS BIGINT)) AS lo,
  we + CAST(TRUNC((we - ws) * GREATEST(buf, 0.0)) AS BIGINT) AS hi FROM v),
x AS (SELECT *, GREATEST(hi - lo - 500000, 0) AS excess FROM b)
SELECT region_id, lo + excess // 2 AS start_pos, hi - (excess - excess // 2) AS end_pos, excess AS trimmed,
  lo AS whole_start, hi AS whole_end FROM x""")
def p10(spark, d):
    end = F.col("start") + (F.col("end") - F.col("start")) * (1 + F.col("region_id") % 3000)
    buf = (F.col("region_id") % 8).cast("double") - 1 + 0.25
    w = V.windows(spark, d).select("region_id", R.buffered_window(F.col("start"), end, buf, 500_000).alias("w"),
        R.buffered_window(F.col("start"), end, buf).alias("whole"))
    return _named(w.select(
        "region_id", "w.*", F.col("whole.start").alias("whole_start"), F.col("whole.end").alias("whole_end")))


@check("p11_variant_padding", f"""{ctes('variants')}
SELECT var_seq, GREATEST(0, pos - 100) AS s0, pos + size + 1 + 100 AS e0,
  GREATEST(0, pos - 50000) AS s1, pos + size + 1 + 50000 AS e1 FROM variants""")
def p11(spark, d):
    pos, end = F.col("pos"), F.col("end")
    return V.variants(spark, d).select(
        "var_seq", R.padded_start(pos, 100).alias("s0"), R.padded_end(end, 100).alias("e0"),
        R.padded_start(pos, 50_000).alias("s1"), R.padded_end(end, 50_000).alias("e1"),
    )


@check("p15_one_based", f"""{ctes('windows')} SELECT region_id, GREATEST(1, ws - 300) AS start_pos,
  GREATEST(GREATEST(1, ws - 300), we - 400) AS end_pos FROM windows""")
def p15(spark, d):
    b = R.one_based(F.col("start") - 300, F.col("end") - 400)
    return _named(V.windows(spark, d).select("region_id", b.alias("b")).select("region_id", "b.*"))


def _texts(spark, d):
    """Region texts of several forms, some of them broken."""
    m = F.col("region_id") % 6
    c, s, e = F.col("chrom"), F.col("start").cast("string"), F.col("end").cast("string")
    text = (
        F.when(m == 0, F.concat(c, F.lit(":"), s, F.lit("-"), e))
        .when(m == 1, F.concat(F.lit("HLA:"), c, F.lit(":"), s, F.lit("-"), e))
        .when(m == 2, F.concat(c, F.lit(":"), s, F.lit(",000-"), e, F.lit(",000")))
        .when(m == 3, F.concat(c, F.lit(":"), s))
        .when(m == 4, F.concat(c, F.lit(":"), e, F.lit("-"), s))
        .otherwise(F.concat(c, F.lit(":x"), s, F.lit("-"), e))
    )
    return V.windows(spark, d).select("region_id", text.alias("t"))


_TEXT_SQL = f"""{ctes('windows')}, texts AS (SELECT region_id, CASE region_id % 6
  WHEN 0 THEN chrom || ':' || ws || '-' || we WHEN 1 THEN 'HLA:' || chrom || ':' || ws || '-' || we
  WHEN 2 THEN chrom || ':' || ws || ',000-' || we || ',000' WHEN 3 THEN chrom || ':' || ws
  WHEN 4 THEN chrom || ':' || we || '-' || ws ELSE chrom || ':x' || ws || '-' || we END AS t FROM windows)"""


def _parsed(df, fn):
    flat = _named(df.select("region_id", fn(F.col("t")).alias("r")).select("region_id", "r.*"))
    return _text(flat, "start_pos", "end_pos")


@check("f1_parse_region", _TEXT_SQL + """, p AS (SELECT region_id, SPLIT_PART(t, ':', 1) AS c,
  SUBSTRING(t, STRPOS(t, ':') + 1) AS rest FROM texts),
q AS (SELECT region_id, c, TRY_CAST(SPLIT_PART(rest, '-', 1) AS BIGINT) AS s,
  TRY_CAST(CASE WHEN STRPOS(rest, '-') > 0 THEN SUBSTRING(rest, STRPOS(rest, '-') + 1) END AS BIGINT) AS e FROM p)
SELECT region_id, CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN c END AS chrom,
  CAST(CASE WHEN e IS NOT NULL THEN s END AS VARCHAR) AS start_pos, CAST(CASE WHEN s IS NOT NULL THEN e END AS VARCHAR) AS end_pos,
  s IS NOT NULL AND e IS NOT NULL AS valid FROM q""")
def f1(spark, d):
    return _parsed(_texts(spark, d), R.parse_region)


@check("f1b_parse_region_greedy", _TEXT_SQL + r""", p AS (SELECT region_id, REGEXP_MATCHES(t, '^(.+):(\d+)-(\d+)$') AS valid,
  REGEXP_EXTRACT(t, '^(.+):(\d+)-(\d+)$', 1) AS c, REGEXP_EXTRACT(t, '^(.+):(\d+)-(\d+)$', 2) AS s,
  REGEXP_EXTRACT(t, '^(.+):(\d+)-(\d+)$', 3) AS e FROM texts)
SELECT region_id, CASE WHEN valid THEN c END AS chrom, CAST(TRY_CAST(s AS BIGINT) AS VARCHAR) AS start_pos, CAST(TRY_CAST(e AS BIGINT) AS VARCHAR) AS end_pos,
  valid FROM p""")
def f1b(spark, d):
    return _parsed(_texts(spark, d), R.parse_region_greedy)


@check("f1c_parse_region_viewer", _TEXT_SQL + """, p AS (SELECT region_id, SPLIT_PART(t, ':', 1) AS c,
  SUBSTRING(t, STRPOS(t, ':') + 1) AS rest FROM texts),
q AS (SELECT region_id, c, TRY_CAST(REPLACE(SPLIT_PART(rest, '-', 1), ',', '') AS BIGINT) AS s,
  TRY_CAST(REPLACE(CASE WHEN STRPOS(rest, '-') > 0 THEN SUBSTRING(rest, STRPOS(rest, '-') + 1) END, ',', '') AS BIGINT) AS e FROM p),
v AS (SELECT *, COALESCE(s >= 1 AND e >= s, FALSE) AS valid FROM q)
SELECT region_id, CASE WHEN valid THEN c END AS chrom, CAST(CASE WHEN valid THEN s END AS VARCHAR) AS start_pos,
  CAST(CASE WHEN valid THEN e END AS VARCHAR) AS end_pos, valid FROM v""")
def f1c(spark, d):
    return _parsed(_texts(spark, d), R.parse_region_viewer)


@check("f2_format_region", f"""{ctes('windows')} SELECT region_id, chrom || ':' || ws || '-' || we AS region FROM windows""")
def f2(spark, d):
    return V.windows(spark, d).select("region_id", R.format_region(F.col("chrom"), F.col("start"), F.col("end")).alias("region"))


_SIZE = """CASE WHEN bp >= 1000000 THEN FORMAT('{:.1f} Mb', CAST(bp AS DOUBLE) / 1000000)
  WHEN bp >= 1000 THEN FORMAT('{:.1f} kb', CAST(bp AS DOUBLE) / 1000) ELSE bp || ' bp' END"""


@check("f3_format_size", f"""{ctes('variants')}, s AS (SELECT var_seq, size, UNNEST([size, size * 50, pos, pos * 50]) AS bp,
  UNNEST([0, 1, 2, 3]) AS form FROM variants) SELECT var_seq, CAST(form AS INTEGER) AS form, bp, {_SIZE} AS txt FROM s""")
def f3(spark, d):
    size, pos = F.col("size"), F.col("pos")
    s = V.variants(spark, d).select("var_seq", F.posexplode(F.array(size, size * 50, pos, pos * 50)).alias("form", "bp"))
    return s.select("var_seq", "form", "bp", R.format_size(F.col("bp")).alias("txt"))


@check("f13_clamps", f"""{ctes('windows')} SELECT region_id,
  CAST(GREATEST(1, LEAST(COALESCE(CASE WHEN region_id % 10 = 0 THEN NULL ELSE CAST(region_id % 200 - 20 AS INTEGER) END, 31), 101)) AS INTEGER) AS k,
  GREATEST(0.0, LEAST(COALESCE(CASE WHEN region_id % 10 = 0 THEN NULL ELSE CAST(region_id % 9 - 2 AS DOUBLE) END, CAST(1 AS DOUBLE)), 5.0)) AS buffer
FROM windows""")
def f13(spark, d):
    r = F.col("region_id")
    known = lambda c: F.when(r % 10 != 0, c)
    return V.windows(spark, d).select(
        "region_id", R.clamp_k(known((r % 200 - 20).cast("int")), 1, 101).alias("k"),
        R.clamp_buffer(known((r % 9 - 2).cast("double")), 0, 5).alias("buffer"),
    )


@check("f19_region_label", f"""{ctes('variants')}, s AS (SELECT *, size AS bp FROM variants)
SELECT var_seq, chrom || ':' || pos || '-' || (pos + size) || ' (' || {_SIZE} || CASE WHEN gt <> '0|0' THEN ', ' || gt ELSE '' END || ')' AS label FROM s""")
def f19(spark, d):
    v = V.variants(spark, d)
    gt = F.when(F.col("genotype") != "0|0", F.col("genotype")).otherwise(F.lit(""))
    return v.select(
        "var_seq", R.region_label(F.col("chrom"), F.col("pos"), F.col("pos") + F.col("size"), F.col("size"), gt).alias("label")
    )


@check("f21_ordered_bounds", f"""{ctes('blocks')} SELECT block_id, LEAST(asm_start, ref_end - 25) AS start_pos,
  GREATEST(asm_start, ref_end - 25) AS end_pos FROM blocks""")
def f21(spark, d):
    b = R.ordered_bounds(F.col("asm_start"), F.col("ref_end") - 25)
    return _named(V.blocks(spark, d).select("block_id", b.alias("b")).select("block_id", "b.*"))
