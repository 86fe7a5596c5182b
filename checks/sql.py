"""SQL pieces shared by several oracles (DuckDB dialect)."""

from __future__ import annotations

ORDER = "ref_start, block_seq, ref_end, asm_chrom, asm_start, asm_end, strand, mapq"

# Predecessor of each block: the earlier one reaching farthest, the first of them.
PREV = f"""
prev AS (
  SELECT *, ARG_MIN(ROW(ref_start, ref_end, asm_chrom, asm_start, asm_end, strand, mapq),
                    ROW(-ref_end, ref_start, block_seq, asm_chrom, asm_start, asm_end, strand, mapq))
    OVER (PARTITION BY sample_id, hap, ref_chrom ORDER BY {ORDER}
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
  FROM kept)"""

PFIELDS = """
flat AS (
  SELECT sample_id, hap, ref_chrom, ref_start, ref_end, block_seq, asm_chrom, asm_start, asm_end, strand, mapq,
    p[1] AS p_rs, p[2] AS p_re, p[3] AS p_ac, p[4] AS p_as, p[5] AS p_ae, p[6] AS p_st, p[7] AS p_mq,
    CASE WHEN p[3] = asm_chrom AND p[6] = strand THEN
      CASE WHEN strand = '+' THEN asm_start - p[5] ELSE p[4] - asm_end END END AS asm_gap
  FROM prev WHERE p IS NOT NULL)"""

GAPS = """
gaps AS (
  SELECT sample_id, hap, ref_chrom, ref_start AS block_start, block_seq, p_re AS ref_start, ref_start AS ref_end,
    p_ac AS asm_chrom,
    CASE WHEN asm_gap IS NULL THEN CASE WHEN p_st = '+' THEN p_ae ELSE p_as END
         WHEN p_st = '+' THEN p_ae ELSE asm_end END AS asm_start,
    CASE WHEN asm_gap IS NULL THEN CASE WHEN p_st = '+' THEN p_ae ELSE p_as END
         WHEN p_st = '+' THEN asm_start ELSE p_as END AS asm_end,
    p_st AS strand, LEAST(p_mq, mapq) AS mapq,
    CASE WHEN p_ac <> asm_chrom THEN 'translocation' WHEN p_st <> strand THEN 'inversion'
         WHEN asm_gap < 0 THEN 'complex' WHEN asm_gap < ref_start - p_re THEN 'deletion'
         ELSE 'insertion' END AS event_type,
    ref_start - p_re AS ref_gap_size, asm_gap AS asm_gap_size
  FROM flat
  WHERE p_re < ref_start OR (p_re = ref_start AND (p_ac <> asm_chrom OR p_st <> strand OR asm_gap <> 0)))"""

# CIGAR operations of distinct blocks with prefix sums.
OPS = r"""
toks AS (
  SELECT block_id, UNNEST(l) AS tok, CAST(GENERATE_SUBSCRIPTS(l, 1) - 1 AS INTEGER) AS op_idx
  FROM (SELECT block_id, REGEXP_EXTRACT_ALL(cigar, '(\d+[MIDNSHPX=])', 1) AS l FROM blocks)),
lens AS (
  SELECT block_id, op_idx, RIGHT(tok, 1) AS op, CAST(LEFT(tok, LENGTH(tok) - 1) AS BIGINT) AS len FROM toks),
ops AS (
  SELECT block_id, op_idx, op, len,
    CAST(SUM(CASE WHEN op IN ('M','D','N','X','=') THEN len ELSE 0 END) OVER w AS BIGINT) AS ref_hi,
    CAST(SUM(CASE WHEN op IN ('M','I','S','X','=') THEN len ELSE 0 END) OVER w AS BIGINT) AS asm_hi
  FROM lens WINDOW w AS (PARTITION BY block_id ORDER BY op_idx))"""

# Window-block overlaps with block offsets.
PAIRS = """
pairs AS (
  SELECT w.region_id, b.*, GREATEST(w.ws, b.ref_start) - b.ref_start AS lo, LEAST(w.we, b.ref_end) - b.ref_start AS hi
  FROM windows w JOIN kept b ON w.sample_id = b.sample_id AND w.chrom = b.ref_chrom
    AND b.ref_start < w.we AND b.ref_end > w.ws)"""

# The derived CIGARs are 10M kD kI rest M, so the offset of an edge is known in closed form.
# Start edge: inside the deletion it clamps to 10; at or past it the insertion is behind.
PROJECTED = """
proj AS (
  SELECT *, CASE WHEN lo < 10 THEN lo WHEN lo < 10 + k THEN 10 ELSE lo END AS qs,
    CASE WHEN hi <= 10 THEN hi WHEN hi <= 10 + k THEN 10 ELSE hi END AS qe
  FROM (SELECT *, CAST(SUBSTRING(cigar, 4, 1) AS BIGINT) AS k FROM pairs)),
aligned AS (
  SELECT region_id, sample_id, hap, ref_start AS block_start, block_seq, CAST(1 AS INTEGER) AS kind, ref_chrom,
    ref_start + lo AS ref_start, ref_start + hi AS ref_end, asm_chrom,
    CASE WHEN strand = '+' THEN asm_start + qs ELSE asm_end - qe END AS asm_start,
    CASE WHEN strand = '+' THEN asm_start + qe ELSE asm_end - qs END AS asm_end,
    strand, mapq, 'alignment' AS event_type,
    CAST(NULL AS BIGINT) AS ref_gap_size, CAST(NULL AS BIGINT) AS asm_gap_size
  FROM proj)"""

SEEN_GAPS = """
seen AS (
  SELECT w.region_id, g.sample_id, g.hap, g.block_start, g.block_seq, CAST(0 AS INTEGER) AS kind, g.ref_chrom,
    g.ref_start, g.ref_end, g.asm_chrom, g.asm_start, g.asm_end, g.strand, g.mapq, g.event_type,
    g.ref_gap_size, g.asm_gap_size
  FROM windows w JOIN gaps g ON w.sample_id = g.sample_id AND w.chrom = g.ref_chrom
    AND g.ref_start > w.ws AND g.ref_end < w.we)"""

# Aligned reads sharing a base with a view.
OVER = """
over_reads AS (
  SELECT s.region_id, s.vs, s.ve, r.* FROM spans s JOIN reads r ON s.sample_id = r.sample_id
    AND s.chrom = r.chrom AND r.start_pos <= s.ve AND r.end_pos >= s.vs AND (r.flags & 4) = 0)"""


def kept(min_mapq: int) -> str:
    return f"kept AS (SELECT * FROM blocks WHERE mapq >= {min_mapq})"


def merged(source: str, keys: str, start: str, end: str, gap: int = 0) -> str:
    """CTEs ``isl`` of the islands of ``source``: keys, start_pos, end_pos, covered, pieces."""
    return f"""
m1 AS (SELECT {keys}, {start} AS s, MAX({end}) AS e FROM {source} GROUP BY ALL),
m2 AS (SELECT *, MAX(e) OVER (PARTITION BY {keys} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM m1),
m3 AS (SELECT *, SUM(CASE WHEN r IS NULL OR s > r + {gap} THEN 1 ELSE 0 END)
         OVER (PARTITION BY {keys} ORDER BY s) AS g FROM m2),
isl AS (SELECT {keys}, g, MIN(s) AS start_pos, MAX(e) AS end_pos,
         CAST(SUM(GREATEST(e - GREATEST(s, COALESCE(r, s)), 0)) AS BIGINT) AS covered,
         CAST(SUM(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) AS BIGINT) AS pieces
       FROM m3 GROUP BY {keys}, g)"""
