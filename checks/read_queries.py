"""Reads: flags, phasing, coverage, comparison, pileups, panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks import views as V
from checks.mapping_queries import _text
from checks.registry import check
from checks.views import ctes
from strandweave.functions import cigar as C
from strandweave.functions import sam
from strandweave.operators import coverage as cov
from strandweave.operators import phasing as ph
from strandweave.operators.cigar_index import cigar_features, visible_indels
from strandweave.plans import reads as P
from strandweave.plans.phasing import phase_and_tag
from strandweave.session import scratch_folder
from strandweave.sources import read_store
from strandweave.sources.alignments import label_tracks

BIN = 1024


def _track(spark, d, name):
    return V.reads(spark, d).filter(F.col("track") == name)


@check("j2_region_read_join", f"""{ctes('reads', 'spans')}, {S.OVER}
SELECT region_id, read_seq, track FROM over_reads""")
def j2(spark, d):
    return P.reads_in_regions(V.spans(spark, d), V.reads(spark, d), BIN).select("region_id", "read_seq", "track")


_STORES: dict[tuple[str, str], str] = {}


def _store(spark, d):
    """All reads as a read store, written once per application and data folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES or not V.is_stored(spark, _STORES[key]):
        _STORES[key] = scratch_folder(spark, "reads")
        read_store.write_reads(V.reads(spark, d), _STORES[key], BIN)
    return _STORES[key]


@check("s4_read_store_window", f"""{ctes('reads')} SELECT read_seq, name, track, start_pos, end_pos, cigar FROM reads
WHERE chrom = 'chr2' AND track IN ('ref', 'hap2') AND start_pos <= 60000 AND end_pos >= 9001""")
def s4_window(spark, d):
    found = read_store.read_window(spark, _store(spark, d), "chr2", 9001, 60_000, ["s0"], ["ref", "hap2"], BIN)
    return found.select("read_seq", "name", "track", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "cigar")


@check("s4_read_store_join", f"""{ctes('reads', 'spans')}, {S.OVER} SELECT region_id, read_seq, track FROM over_reads""")
def s4_join(spark, d):
    stored = read_store.open_reads(spark, _store(spark, d)).where(sam.is_mapped(F.col("flags")))
    return read_store.reads_of_regions(V.spans(spark, d), stored, BIN).select("region_id", "read_seq", "track")


@check("f17_flags", f"""{ctes('reads')} SELECT read_seq, (flags & 4) <> 0 AS unmapped, (flags & 16) <> 0 AS is_reverse,
  (flags & 256) <> 0 AS is_secondary FROM reads""")
def f17(spark, d):
    bit = lambda b: sam.has_flag(F.col("flags"), b)
    return V.reads(spark, d).select(
        "read_seq", bit(sam.UNMAPPED).alias("unmapped"), bit(sam.REVERSED).alias("is_reverse"),
        bit(sam.SECONDARY).alias("is_secondary"),
    )


@check("f15_alignment_end", f"""{ctes('reads')} SELECT read_seq, end_pos FROM reads""")
def f15(spark, d):
    end = C.alignment_end(F.col("start"), F.col("cigar"))
    return V.reads(spark, d).select("read_seq", end.alias("end_pos"))


@check("f16_hp_tag", f"""{ctes('reads')} SELECT read_seq, CAST(hp AS VARCHAR) AS hp FROM reads""")
def f16(spark, d):
    tags = F.array(F.lit("NM:i:3"), F.concat(F.lit("HP:"), F.when(F.col("hp").isNull(), "Z:x").otherwise(F.concat(F.lit("i:"), F.col("hp").cast("string")))))
    return _text(V.reads(spark, d).select("read_seq", sam.int_tag(tags, "HP").alias("hp")), "hp")


@check("p7_scored_reads", f"""{ctes('reads')} SELECT read_seq, as_score FROM reads WHERE (flags & 4) = 0 AND as_score IS NOT NULL""")
def p7(spark, d):
    r = V.reads(spark, d)
    return r.filter(sam.has_score(F.col("flags"), F.col("as_score"))).select("read_seq", "as_score")


# Positions of the pieces of the derived CIGAR 5S aM 3I xX bD cM [7S].
_PARTS = f"""{ctes('reads')}, parts AS (SELECT *, 20 + read_seq % 10 AS a, 1 + read_seq % 3 AS x, 40 + read_seq % 30 AS b FROM reads)"""


@check("f14_cigar_features", f"""{_PARTS}
SELECT read_seq, 'indel' AS what, CAST(start_pos + a AS BIGINT) AS ref_pos, CAST(3 AS INTEGER) AS size, 'insertion' AS detail FROM parts
UNION ALL SELECT read_seq, 'indel', start_pos + a + x, CAST(b AS INTEGER), 'deletion' FROM parts
UNION ALL SELECT read_seq, 'mismatch', start_pos + a + UNNEST(RANGE(x)), 1, 'X' FROM parts
UNION ALL SELECT read_seq, 'clip', start_pos, 5, 'true' FROM parts
UNION ALL SELECT read_seq, 'clip', end_pos + 1, 7, 'false' FROM parts WHERE read_seq % 2 = 0""")
def f14(spark, d):
    f = cigar_features(V.reads(spark, d).select("read_seq", "start", "cigar"), ["read_seq"])
    row = lambda what, pos, size, detail: F.struct(
        F.lit(what).alias("what"), pos.alias("ref_pos"), size.cast("int").alias("size"), detail.cast("string").alias("detail")
    )
    every = F.concat(
        F.transform("indels", lambda x: row("indel", x["ref_pos"], x["length"], x["kind"])),
        F.transform("mismatches", lambda x: row("mismatch", x["ref_pos"], F.lit(1), x["read_base"])),
        F.transform("soft_clips", lambda x: row("clip", x["ref_pos"], x["length"], x["is_leading"])),
    )
    return f.select("read_seq", F.explode(every).alias("x")).select("read_seq", "x.*")


@check("p8_visible_indels", f"""{_PARTS}
SELECT read_seq, CAST(CASE WHEN b > 50 THEN 1 ELSE 0 END AS INTEGER) AS n_visible, CAST(2 AS INTEGER) AS n_all,
  CAST(CASE WHEN b > 60 THEN 1 ELSE 0 END AS INTEGER) AS n_over_60 FROM parts""")
def p8(spark, d):
    f = cigar_features(V.reads(spark, d).select("read_seq", "start", "cigar"), ["read_seq"])
    n = lambda *a: F.size(visible_indels(F.col("indels"), *a))
    return f.select("read_seq", n().alias("n_visible"), n(50, False).alias("n_all"), n(60).alias("n_over_60"))


@check("p13_read_summary", f"""{ctes('reads')} SELECT name, start_pos, end_pos, (flags & 16) <> 0 AS is_reverse,
  CAST(mapq AS VARCHAR) AS mapq, CAST(hp AS VARCHAR) AS hp, CAST(2 AS INTEGER) AS indel_count, end_pos - start_pos + 1 AS alignment_length FROM reads""")
def p13(spark, d):
    full = cigar_features(V.reads(spark, d), ["read_seq"])
    out = cov.read_summary(full).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})
    return _text(out, "mapq", "hp")


# --- phasing ---------------------------------------------------------------------------

_PHASE = f"""{ctes('reads')}, sc AS (SELECT * FROM reads WHERE (flags & 4) = 0 AND as_score IS NOT NULL),
h1 AS (SELECT name, MAX(as_score) AS s1 FROM sc WHERE track = 'hap1' GROUP BY name),
h2 AS (SELECT name, MAX(as_score) AS s2 FROM sc WHERE track = 'hap2' GROUP BY name),
both_sides AS (SELECT name, s1, s2 FROM h1 FULL OUTER JOIN h2 USING (name))"""


def _assigned(tol: int) -> str:
    return f"""phase AS (SELECT name, CAST(CASE WHEN s2 IS NULL THEN 1 WHEN s1 IS NULL THEN 2 WHEN s1 - s2 > {tol} THEN 1
  WHEN s1 - s2 < -{tol} THEN 2 ELSE 0 END AS INTEGER) AS hp FROM both_sides)"""


@check("a1_best_scores", f"""{_PHASE} SELECT name, s1 AS score FROM h1""")
def a1(spark, d):
    return ph.best_scores(_track(spark, d, "hap1"))


@check("j3_score_join", f"""{_PHASE} SELECT name, CAST(s1 AS VARCHAR) AS s1, CAST(s2 AS VARCHAR) AS s2 FROM both_sides""")
def j3(spark, d):
    one = ph.best_scores(_track(spark, d, "hap1")).withColumnRenamed("score", "s1")
    two = ph.best_scores(_track(spark, d, "hap2")).withColumnRenamed("score", "s2")
    return _text(one.join(two, "name", "full_outer"), "s1", "s2")


@check("u3_scored_names", f"""{_PHASE} SELECT name FROM both_sides""")
def u3(spark, d):
    return ph.phase_reads(_track(spark, d, "hap1"), _track(spark, d, "hap2")).select("name")


@check("f9_assign_hp", f"""{_PHASE}, {_assigned(200)} SELECT name, hp FROM phase""")
def f9(spark, d):
    return ph.phase_reads(_track(spark, d, "hap1"), _track(spark, d, "hap2"), 200)


@check("a2_phase_counts", f"""{_PHASE}, {_assigned(50)} SELECT CAST(COUNT(*) FILTER (hp = 1) AS BIGINT) AS hap1,
  CAST(COUNT(*) FILTER (hp = 2) AS BIGINT) AS hap2, CAST(COUNT(*) FILTER (hp = 0) AS BIGINT) AS ambiguous FROM phase""")
def a2(spark, d):
    return phase_and_tag(V.reads(spark, d), 50)[1]


@check("j4_tag_join", f"""{_PHASE}, {_assigned(0)} SELECT r.read_seq, CAST(COALESCE(p.hp, r.hp) AS VARCHAR) AS hp
FROM reads r LEFT JOIN phase p USING (name)""")
def j4(spark, d):
    phase = ph.phase_reads(_track(spark, d, "hap1"), _track(spark, d, "hap2"))
    return _text(ph.tag_reads(V.reads(spark, d), phase).select("read_seq", "hp"), "hp")


# Two samples whose reads share names.
_SAMPLES = f"""{ctes('reads')}, two AS (SELECT * REPLACE ('s' || (read_seq // 4 % 2) AS sample_id) FROM reads),
sc AS (SELECT * FROM two WHERE (flags & 4) = 0 AND as_score IS NOT NULL),
h1 AS (SELECT sample_id, name, MAX(as_score) AS s1 FROM sc WHERE track = 'hap1' GROUP BY ALL),
h2 AS (SELECT sample_id, name, MAX(as_score) AS s2 FROM sc WHERE track = 'hap2' GROUP BY ALL),
both_sides AS (SELECT sample_id, name, s1, s2 FROM h1 FULL OUTER JOIN h2 USING (sample_id, name)),
{_assigned(20).replace("SELECT name", "SELECT sample_id, name")}"""


@check("q5_phase_reads", f"""{_SAMPLES}
SELECT r.sample_id, r.track, COALESCE(CAST(COALESCE(p.hp, r.hp) AS VARCHAR), 'none') AS hp, CAST(COUNT(*) AS BIGINT) AS n
FROM two r LEFT JOIN phase p USING (sample_id, name) GROUP BY ALL""")
def q5(spark, d):
    reads = V.reads(spark, d).withColumn("sample_id", F.concat(F.lit("s"), (F.floor(F.col("read_seq") / 4) % 2).cast("string")))
    tagged = phase_and_tag(reads, 20)[2]
    return tagged.groupBy("sample_id", "track", F.coalesce(F.col("hp").cast("string"), F.lit("none")).alias("hp")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- coverage and comparison --------------------------------------------------------------

def _coverage_sql(bins: int) -> str:
    return f"""{ctes('reads', 'spans')}, {S.OVER},
geo AS (SELECT region_id, vs, ve, GREATEST(1, CAST(CEIL((ve - vs) / {bins}.0) AS BIGINT)) AS size FROM spans WHERE ve > vs),
grid AS (SELECT region_id, vs, ve, size, UNNEST(RANGE({bins})) AS bin FROM geo),
hits AS (SELECT o.region_id, o.hp, (GREATEST(start_pos, o.vs) - o.vs) // size AS f,
  LEAST(GREATEST(LEAST(end_pos, o.ve) - o.vs - 1, 0) // size, {bins} - 1) AS l FROM over_reads o JOIN geo USING (region_id)),
cells AS (SELECT region_id, hp, UNNEST(RANGE(f, l + 1)) AS bin FROM hits WHERE f <= l),
depth AS (SELECT region_id, bin, COUNT(*) AS n, COUNT(*) FILTER (hp = 1) AS n1, COUNT(*) FILTER (hp = 2) AS n2 FROM cells GROUP BY ALL)
SELECT region_id, CAST(bin AS INTEGER) AS bin, vs + bin * size AS bin_start, LEAST(vs + (bin + 1) * size, ve) AS bin_end,
  CAST(COALESCE(n, 0) AS BIGINT) AS depth, CAST(COALESCE(n1, 0) AS BIGINT) AS hap1_depth,
  CAST(COALESCE(n2, 0) AS BIGINT) AS hap2_depth FROM grid LEFT JOIN depth USING (region_id, bin)"""


@check("a3_binned_coverage", _coverage_sql(20))
def a3(spark, d):
    return P.coverage(V.spans(spark, d), V.reads(spark, d), 20, BIN)


@check("q7_coverage_50_bins", _coverage_sql(50))
def q7(spark, d):
    return P.coverage(V.spans(spark, d), V.reads(spark, d), 50, BIN)


_COMPARE = f"""{ctes('reads', 'spans')}, {S.OVER},
names AS (SELECT region_id, name, BOOL_OR(track = 'ref') AS r, BOOL_OR(track = 'hap1') AS a, BOOL_OR(track = 'hap2') AS b
  FROM over_reads WHERE track <> 'other' GROUP BY ALL)"""


@check("q8_compare_reads", f"""{_COMPARE} SELECT region_id,
  CAST(COUNT(*) FILTER (r AND NOT a AND NOT b) AS BIGINT) AS ref_only, CAST(COUNT(*) FILTER (NOT r AND a AND NOT b) AS BIGINT) AS hap1_only,
  CAST(COUNT(*) FILTER (NOT r AND NOT a AND b) AS BIGINT) AS hap2_only, CAST(COUNT(*) FILTER (r AND a AND NOT b) AS BIGINT) AS ref_and_hap1,
  CAST(COUNT(*) FILTER (r AND NOT a AND b) AS BIGINT) AS ref_and_hap2, CAST(COUNT(*) FILTER (NOT r AND a AND b) AS BIGINT) AS hap1_and_hap2,
  CAST(COUNT(*) FILTER (r AND a AND b) AS BIGINT) AS all_three, CAST(COUNT(name) AS BIGINT) AS total_unique
FROM spans LEFT JOIN names USING (region_id) GROUP BY region_id""")
def q8(spark, d):
    return P.compare_reads(V.spans(spark, d), V.reads(spark, d), BIN)


@check("a4_compare_all_reads", f"""{ctes('reads')}, names AS (SELECT chrom, name, BOOL_OR(track = 'ref') AS r, BOOL_OR(track = 'hap1') AS a,
  BOOL_OR(track = 'hap2') AS b FROM reads WHERE track <> 'other' GROUP BY ALL)
SELECT chrom, CAST(COUNT(*) FILTER (r AND NOT a AND NOT b) AS BIGINT) AS ref_only, CAST(COUNT(*) FILTER (NOT r AND a AND NOT b) AS BIGINT) AS hap1_only,
  CAST(COUNT(*) FILTER (NOT r AND NOT a AND b) AS BIGINT) AS hap2_only, CAST(COUNT(*) FILTER (r AND a AND NOT b) AS BIGINT) AS ref_and_hap1,
  CAST(COUNT(*) FILTER (r AND NOT a AND b) AS BIGINT) AS ref_and_hap2, CAST(COUNT(*) FILTER (NOT r AND a AND b) AS BIGINT) AS hap1_and_hap2,
  CAST(COUNT(*) FILTER (r AND a AND b) AS BIGINT) AS all_three, CAST(COUNT(*) AS BIGINT) AS total_unique FROM names GROUP BY chrom""")
def a4(spark, d):
    return cov.compare_read_sets(V.reads(spark, d), ["chrom"])


@check("j11_name_membership", f"""{ctes('reads')} SELECT name, BOOL_OR(track = 'ref') AS in_ref, BOOL_OR(track = 'hap1') AS in_hap1,
  BOOL_OR(track = 'hap2') AS in_hap2 FROM reads GROUP BY name""")
def j11(spark, d):
    seen = lambda t: F.max(F.col("track") == t)
    return V.reads(spark, d).groupBy("name").agg(
        seen("ref").alias("in_ref"), seen("hap1").alias("in_hap1"), seen("hap2").alias("in_hap2")
    )


@check("u4_set_counts", f"""{_COMPARE} SELECT CAST(COUNT(*) FILTER (r AND a AND b) AS BIGINT) AS in_all,
  CAST(COUNT(*) FILTER (r AND NOT a AND NOT b) AS BIGINT) AS only_ref FROM names""")
def u4(spark, d):
    sets = P.compare_reads(V.spans(spark, d), V.reads(spark, d), BIN)
    return sets.agg(F.sum("all_three").alias("in_all"), F.sum("ref_only").alias("only_ref"))


@check("u5_total_unique", f"""{_COMPARE} SELECT region_id, CAST(COUNT(name) AS BIGINT) AS total_unique
FROM spans LEFT JOIN names USING (region_id) GROUP BY region_id""")
def u5(spark, d):
    return P.compare_reads(V.spans(spark, d), V.reads(spark, d), BIN).select("region_id", "total_unique")


@check("a5_read_stats", f"""{ctes('reads', 'spans')}, {S.OVER} SELECT region_id, CAST(COUNT(read_seq) AS BIGINT) AS n_reads,
  CAST(COUNT(*) FILTER ((flags & 16) <> 0) AS BIGINT) AS n_reverse, CAST(COUNT(*) FILTER ((flags & 256) <> 0) AS BIGINT) AS n_secondary,
  CAST(CAST(SUM(mapq) // COUNT(mapq) AS BIGINT) AS VARCHAR) AS avg_mapq FROM spans LEFT JOIN over_reads USING (region_id) GROUP BY region_id""")
def a5(spark, d):
    return _text(P.region_stats(V.spans(spark, d), V.reads(spark, d), BIN), "avg_mapq")


# --- pileups -----------------------------------------------------------------------------------

def _lanes_sql(group: str) -> str:
    """CTE ``laid``: the greedy scan read by read, carrying where each lane of a panel ends."""
    start = f"{ctes('reads', 'spans')}, {S.OVER}".replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{start},
queue AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY region_id, track, g ORDER BY start_pos, read_seq) AS n
  FROM (SELECT region_id, track, read_seq, start_pos, end_pos, {group} AS g FROM over_reads)),
laid AS (SELECT region_id, track, g, n, read_seq, 0 AS lane, [end_pos] AS ends FROM queue WHERE n = 1
  UNION ALL SELECT region_id, track, g, n, read_seq, CASE WHEN free THEN p - 1 ELSE LEN(ends) END,
    CASE WHEN free THEN LIST_CONCAT(LIST_CONCAT(ends[:p - 1], [end_pos]), ends[p + 1:]) ELSE LIST_APPEND(ends, end_pos) END
  FROM (SELECT q.*, l.ends, LIST_POSITION(l.ends, LIST_MIN(l.ends)) AS p, q.start_pos > LIST_MIN(l.ends) + 5 AS free
    FROM laid l JOIN queue q ON q.region_id = l.region_id AND q.track = l.track AND q.g = l.g AND q.n = l.n + 1))"""


@check("w6_lane_packing", f"""{_lanes_sql('0')} SELECT region_id, track, read_seq, CAST(lane AS INTEGER) AS lane FROM laid""")
def w6(spark, d):
    return P.pileup(V.spans(spark, d), V.reads(spark, d), False, BIN)


@check("w7_lanes_by_haplotype", f"""{_lanes_sql('CASE hp WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END')},
tops AS (SELECT region_id, track, COALESCE(MAX(lane + 1) FILTER (g = 1), 0) AS n1, COALESCE(MAX(lane + 1) FILTER (g = 2), 0) AS n2
  FROM laid GROUP BY ALL),
offs AS (SELECT *, CASE WHEN n1 > 0 THEN n1 + 1 ELSE 0 END AS o2 FROM tops)
SELECT region_id, track, read_seq, CAST(lane + CASE g WHEN 1 THEN 0 WHEN 2 THEN o2 ELSE o2 + CASE WHEN n2 > 0 THEN n2 + 1 ELSE 0 END END AS INTEGER) AS lane
FROM laid JOIN offs USING (region_id, track)""")
def w7(spark, d):
    return P.pileup(V.spans(spark, d), V.reads(spark, d), True, BIN)


# The number of lanes is the greatest number of reads that are open, a gap of 5 included, at any start.
_LANES = """opened AS (SELECT a.region_id, a.track, a.read_seq,
  CAST(COUNT(*) AS BIGINT) AS open_reads FROM over_reads a JOIN over_reads b ON a.region_id = b.region_id AND a.track = b.track
  AND (b.start_pos < a.start_pos OR (b.start_pos = a.start_pos AND b.read_seq <= a.read_seq)) AND b.end_pos + 5 >= a.start_pos GROUP BY ALL)"""


@check("q9_pileup_height", f"""{ctes('reads', 'spans')}, {S.OVER}, {_LANES}
SELECT region_id, track, MAX(open_reads) AS lanes FROM opened GROUP BY ALL""")
def q9(spark, d):
    lanes = P.pileup(V.spans(spark, d), V.reads(spark, d), False, BIN)
    return lanes.groupBy("region_id", "track").agg((F.max("lane") + 1).cast("bigint").alias("lanes"))


@check("l6_reads_by_start", f"""{ctes('reads')} SELECT read_seq, chrom, track, start_pos,
  ROW_NUMBER() OVER (ORDER BY chrom, track, start_pos, read_seq) - 1 AS ord FROM reads""")
def l6(spark, d):
    return V.numbered(V.reads(spark, d).orderBy("chrom", "track", "start", "read_seq").select(
        "read_seq", "chrom", "track", F.col("start").alias("start_pos")
    ))


@check("s13_tracks", f"""{ctes('reads', 'spans')}, {S.OVER} SELECT region_id, track || '_track' AS track, CAST(COUNT(*) AS BIGINT) AS n
FROM over_reads WHERE track <> 'other' GROUP BY ALL""")
def s13(spark, d):
    tracks = label_tracks({f"{t}_track": _track(spark, d, t) for t in ("ref", "hap1", "hap2")})
    seen = P.reads_in_regions(V.spans(spark, d), tracks, BIN)
    return seen.groupBy("region_id", "track").agg(F.count(F.lit(1)).alias("n"))


# --- region panels --------------------------------------------------------------------------------

# Every third window brings its own haplotype places; reads stand on the block coordinates.
_PANELS = f"""{ctes('blocks', 'windows', 'reads')}, {S.kept(0)}, {S.PAIRS}, {S.PROJECTED},
boxes AS (SELECT region_id, hap, asm_chrom, GREATEST(MIN(LEAST(asm_start, asm_end)), 1) AS s, MAX(GREATEST(asm_start, asm_end)) AS e
  FROM aligned GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY region_id, hap ORDER BY asm_chrom) AS rn FROM boxes WHERE e >= s) WHERE rn = 1),
panels AS (SELECT region_id, 'ref' AS panel, chrom, ws AS s, we AS e FROM windows
  UNION ALL SELECT region_id, 'hap1', 'ctg0', ws + 1, we + 1 FROM windows WHERE region_id % 3 = 0
  UNION ALL SELECT region_id, hap, asm_chrom, s, e FROM best WHERE NOT (region_id % 3 = 0 AND hap = 'hap1'))"""


def _panel_inputs(spark, d):
    w = V.windows(spark, d)
    own = F.when(
        F.col("region_id") % 3 == 0,
        F.array(F.format_string("ctg0:%d-%d", F.col("start") + 1, F.col("end") + 1), F.lit("ctg9:1-2")),
    ).otherwise(F.array().cast("array<string>"))
    w = w.withColumn("hap1_regions", own).withColumn("hap2_regions", F.array().cast("array<string>"))
    return w, V.blocks(spark, d)


@check("w8_panel_places", f"""{_PANELS} SELECT region_id, panel, chrom, s AS start_pos, e AS end_pos FROM panels""")
def w8(spark, d):
    w, b = _panel_inputs(spark, d)
    return P.panel_regions(w, b, bin_width=256).select(
        "region_id", "panel", "chrom", F.col("start").alias("start_pos"), F.col("end").alias("end_pos")
    )


@check("q13_region_panel", f"""{_PANELS},
placed AS (SELECT read_seq, start_pos, end_pos, flags, mapq, track AS panel,
  CASE WHEN track = 'ref' THEN chrom ELSE 'ctg' || (read_seq % 3) END AS chrom,
  'reads_to_' || track AS track FROM reads WHERE track <> 'other' AND (flags & 4) = 0),
shown AS (SELECT *, UNNEST(CASE panel WHEN 'ref' THEN ['reads_to_ref', 'hap1_to_ref', 'hap2_to_ref']
  WHEN 'hap1' THEN ['reads_to_hap1', 'ref_to_hap1', 'hap2_to_hap1'] ELSE ['reads_to_hap2', 'ref_to_hap2', 'hap1_to_hap2'] END) AS track FROM panels)
SELECT p.region_id, p.panel, p.track, CAST(COUNT(read_seq) AS BIGINT) AS n_reads,
  CAST(COUNT(*) FILTER ((flags & 16) <> 0) AS BIGINT) AS n_reverse, CAST(COUNT(*) FILTER ((flags & 256) <> 0) AS BIGINT) AS n_secondary,
  CAST(CAST(SUM(mapq) // COUNT(mapq) AS BIGINT) AS VARCHAR) AS avg_mapq
FROM shown p LEFT JOIN placed r ON p.track = r.track AND p.chrom = r.chrom AND r.start_pos <= p.e AND r.end_pos >= p.s GROUP BY ALL""")
def q13(spark, d):
    w, b = _panel_inputs(spark, d)
    r = V.reads(spark, d).filter(F.col("track") != "other")
    on_ref = F.col("track") == "ref"
    contig = F.concat(F.lit("ctg"), (F.col("read_seq") % 3).cast("string"))
    r = r.withColumn("chrom", F.when(on_ref, F.col("chrom")).otherwise(contig)).withColumn(
        "track", F.concat(F.lit("reads_to_"), "track")
    )
    return _text(P.region_panel(w, b, r, bin_width=256), "avg_mapq")
