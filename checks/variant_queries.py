"""Choosing variants, cutting subsets, checking manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks import views as V
from checks.registry import check
from checks.views import ctes
from strandweave.functions import sam
from strandweave.operators import variants as O
from strandweave.plans import subset as P

BIN = 1024


@check("f18_genotype", f"""{ctes('variants')} SELECT var_seq, REPLACE(gt, '/', '|') AS gt FROM variants""")
def f18(spark, d):
    field = F.concat("genotype", F.lit(":35:"), F.col("size").cast("string"))
    return V.variants(spark, d).select("var_seq", sam.genotype(field).alias("gt"))


@check("w5_largest_per_chrom", f"""{ctes('variants')} SELECT chrom, var_seq, pos, size FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY chrom ORDER BY size DESC, var_seq) AS rn FROM variants) WHERE rn = 1""")
def w5(spark, d):
    return O.largest_per_chrom(V.variants(spark, d)).select("chrom", "var_seq", "pos", "size")


def _pick_sql(k: int) -> str:
    return f"""tops AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY chrom ORDER BY size DESC, var_seq) AS rn FROM variants)
  WHERE rn = 1 ORDER BY size DESC, var_seq LIMIT {k}),
rest AS (SELECT v.* FROM variants v LEFT JOIN tops t ON v.chrom = t.chrom AND v.pos = t.pos WHERE t.chrom IS NULL),
cand AS (SELECT 0 AS pass, var_seq, chrom, pos, size, gt FROM tops UNION ALL SELECT 1, var_seq, chrom, pos, size, gt FROM rest),
picked AS (SELECT * FROM cand ORDER BY pass, size DESC, var_seq LIMIT {k})"""


@check("l3_diverse_top_k", f"""{ctes('variants')}, {_pick_sql(40)} SELECT var_seq, chrom, pos, size,
  CAST(ROW_NUMBER() OVER (ORDER BY chrom, pos, pass, size DESC, var_seq) AS INTEGER) AS pick_ord FROM picked""")
def l3(spark, d):
    return O.select_variants(V.variants(spark, d), 40).select("var_seq", "chrom", "pos", "size", "pick_ord")


@check("l3_fewer_than_chroms", f"""{ctes('variants')}, {_pick_sql(7)} SELECT var_seq, chrom, pos, size,
  CAST(ROW_NUMBER() OVER (ORDER BY chrom, pos, pass, size DESC, var_seq) AS INTEGER) AS pick_ord FROM picked""")
def l3_few(spark, d):
    return O.select_variants(V.variants(spark, d), 7).select("var_seq", "chrom", "pos", "size", "pick_ord")


@check("j10_not_chosen", f"""{ctes('variants')}, {_pick_sql(23)} SELECT v.var_seq FROM variants v
WHERE NOT EXISTS (SELECT 1 FROM picked p WHERE p.chrom = v.chrom AND p.pos = v.pos)""")
def j10(spark, d):
    v = V.variants(spark, d)
    return v.join(O.select_variants(v, 23).select("chrom", "pos"), ["chrom", "pos"], "left_anti").select("var_seq")


@check("a12_chromosome_count", f"""{ctes('variants')} SELECT CAST(COUNT(DISTINCT chrom) AS BIGINT) AS n_chroms FROM variants""")
def a12(spark, d):
    return O.chromosome_count(V.variants(spark, d))


def _on_block_chroms(spark, d):
    """Variants moved to the chromosomes and coordinates of the blocks."""
    v = V.variants(spark, d)
    chrom = F.concat(F.lit("chr"), (F.col("var_seq") % 5 + 1).cast("string"))
    return v.withColumn("chrom", chrom).withColumn("pos", F.col("var_seq") * 40).withColumn(
        "end", F.col("pos") + F.col("size") + 1
    )


_MANIFEST = f"""{ctes('variants', 'blocks')}, {S.kept(0)},
moved AS (SELECT var_seq, 'chr' || (var_seq % 5 + 1) AS chrom, var_seq * 40 AS pos, size, gt FROM variants),
windows AS (SELECT var_seq AS region_id, 's0' AS sample_id, chrom, GREATEST(0, pos - 100) AS ws, pos + size + 1 + 100 AS we FROM moved),
{S.PAIRS}, {S.PROJECTED}, bounds AS (SELECT region_id, hap, asm_chrom, LEAST(asm_start, asm_end) AS s, GREATEST(asm_start, asm_end) AS e FROM aligned),
{S.merged('bounds', 'region_id, hap, asm_chrom', 's', 'e')},
lists AS (SELECT region_id, hap, STRING_AGG(asm_chrom || ':' || start_pos || '-' || end_pos, ' ' ORDER BY asm_chrom, start_pos) AS t FROM isl GROUP BY ALL)
SELECT v.var_seq, v.chrom, v.chrom || ':' || GREATEST(0, pos - 100) || '-' || (pos + size + 101) AS fasta_region,
  COALESCE(a.t, '') AS hap1_regions, COALESCE(b.t, '') AS hap2_regions
FROM moved v LEFT JOIN lists a ON a.region_id = var_seq AND a.hap = 'hap1' LEFT JOIN lists b ON b.region_id = var_seq AND b.hap = 'hap2'"""


@check("q10_compute_regions", _MANIFEST)
def q10(spark, d):
    r = P.compute_regions(_on_block_chroms(spark, d), V.lookup(spark, d), "s0", 100)
    return r.select(
        "var_seq", "chrom", "fasta_region", F.array_join("hap1_regions", " ").alias("hap1_regions"),
        F.array_join("hap2_regions", " ").alias("hap2_regions"),
    )


def _manifest_table(spark, d):
    """A manifest whose rows break one rule here and there."""
    v = V.variants(spark, d)
    n, pos, size = F.col("var_seq"), F.col("pos"), F.col("size")
    text = lambda a, b: F.concat("chrom", F.lit(":"), a.cast("string"), F.lit("-"), b.cast("string"))
    return v.select(
        "chrom", "pos", F.when(n % 17 == 0, F.lit(0).cast("bigint")).otherwise(size).alias("size"),
        F.when(n % 13 != 0, F.col("genotype")).alias("genotype"),
        F.when(n % 11 == 0, F.col("chrom")).otherwise(text(pos, pos + size)).alias("ref_region"),
        text(pos - 50, pos + F.floor(size / (1 + n % 7))).alias("fasta_region"),
        F.array(F.lit("c:1-2"), F.when(n % 19 == 0, F.lit("c:1")).otherwise(F.lit("c:5-6"))).alias("hap1_regions"),
        F.array().cast("array<string>").alias("hap2_regions"),
    )


@check("q15_check_variants", f"""{ctes('variants')}, m AS (SELECT var_seq AS n, chrom, pos, size AS s0,
  CASE WHEN var_seq % 17 = 0 THEN 0 ELSE size END AS size, CASE WHEN var_seq % 13 <> 0 THEN gt END AS gt,
  pos - 50 AS fs, pos + size // (1 + var_seq % 7) AS fe FROM variants)
SELECT CAST(COUNT(*) AS BIGINT) AS n_variants, CAST(COUNT(DISTINCT chrom) AS BIGINT) AS n_chroms,
  CAST(COUNT(*) FILTER (gt IS NULL) AS BIGINT) AS missing_field,
  CAST(COUNT(*) FILTER (n % 11 = 0 OR n % 19 = 0 OR fs < 0) AS BIGINT) AS bad_format,
  CAST(COUNT(*) FILTER (size <= 0) AS BIGINT) AS bad_size,
  CAST(COUNT(*) FILTER (NOT COALESCE(CONTAINS(gt, '|') AND CONTAINS(gt, '1'), FALSE)) AS BIGINT) AS bad_genotype,
  CAST(COUNT(*) FILTER (n % 11 = 0 OR s0 <> size) AS BIGINT) AS bad_ref_region,
  CAST(COUNT(*) FILTER (fs < 0 OR fe - fs <= size) AS BIGINT) AS bad_fasta_region FROM m""")
def q15(spark, d):
    return O.check_variants(_manifest_table(spark, d))


# --- subsetting reads -----------------------------------------------------------------------------

def _sam_reads(spark, d):
    """Reads with a SAM record: mates here, elsewhere and nowhere, and supplementary entries."""
    r = V.reads(spark, d)
    n, s = F.col("read_seq"), F.col("start").cast("string")
    far = F.concat(F.lit("chr"), (n % 5 + 1).cast("string"))
    mate = F.when(n % 4 == 0, "=").when(n % 4 == 1, "*").when(n % 4 == 2, far).otherwise("chr1:1-4000")
    sa = F.concat(
        F.lit("SA:Z:chr"), (n % 4 + 1).cast("string"), F.lit(","), (F.col("start") + 40).cast("string"),
        F.lit(",+,50M,60,0;chr2,"), s, F.lit(",-,9M,3,1;chr1,5;"),
    )
    line = F.concat_ws(
        "\t", "name", F.col("flags").cast("string"), "chrom", s, F.lit("60"), "cigar", mate,
        F.when(n % 4 == 1, "0").otherwise((F.col("start") + 500).cast("string")), F.lit("0"), F.lit("*"), F.lit("*"),
        F.lit("NM:i:1"), F.when(n % 3 != 0, sa).otherwise(F.lit("XX:Z:none")), F.lit("ZZ:i:7"),
    )
    return r.withColumn("line", line)


def _cut_regions(spark, d):
    """Regions every 3,000 bases; with the reads' length some records lie in two."""
    o = V.table(spark, d, "orders").select("o_orderkey")
    start = (F.col("o_orderkey") * 3000 + 1).cast("bigint")
    return o.select(
        F.col("o_orderkey").alias("region_ord"),
        F.concat(F.lit("chr"), (F.col("o_orderkey") % 3 + 1).cast("string")).alias("chrom"),
        start.alias("start"), (start + 3999).alias("end"),
    )


_CUT = f"""{ctes('reads')}, regions AS (SELECT o_orderkey AS ord, 'chr' || (o_orderkey % 3 + 1) AS chrom, o_orderkey * 3000 + 1 AS s,
  o_orderkey * 3000 + 4000 AS e FROM orders),
named AS (SELECT *, chrom || ':' || s || '-' || e AS text FROM regions),
found AS (SELECT n.ord, n.s, n.text, r.* FROM named n JOIN reads r ON r.chrom = n.chrom AND r.start_pos <= n.e AND r.end_pos >= n.s AND (r.flags & 4) = 0),
kept AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY name, flags, chrom, start_pos ORDER BY ord, read_seq) AS rn FROM found) WHERE rn = 1)"""


@check("a11_dedup_reads", f"""{_CUT} SELECT ord AS region_ord, read_seq FROM kept""")
def a11(spark, d):
    return P.subset_reads(_cut_regions(spark, d), _sam_reads(spark, d), BIN).select("region_ord", "read_seq")


# Where the supplementary entries of a read go: to the first region holding them.
_SA = """ent AS (SELECT read_seq, 0 AS k, 'chr' || (read_seq % 4 + 1) AS c, start_pos + 40 AS p, ',+,50M,60,0' AS tail FROM kept WHERE read_seq % 3 <> 0
  UNION ALL SELECT read_seq, 1, 'chr2', start_pos, ',-,9M,3,1' FROM kept WHERE read_seq % 3 <> 0),
won AS (SELECT e.read_seq, k, tail, ARG_MIN(n.text, n.ord) AS t, ARG_MIN(GREATEST(1, p - n.s + 1), n.ord) AS q
  FROM ent e JOIN named n ON n.chrom = e.c AND e.p BETWEEN n.s AND n.e GROUP BY ALL),
sa AS (SELECT read_seq, 'SA:Z:' || STRING_AGG(t || ',' || q || tail || ';', '' ORDER BY k) AS sa FROM won GROUP BY read_seq)"""


@check("j7_supplementary", f"""{_CUT}, {_SA} SELECT k.read_seq, CASE WHEN k.read_seq % 3 <> 0 THEN COALESCE(sa.sa, 'SA:Z:*') ELSE 'XX:Z:none' END AS sa
FROM kept k LEFT JOIN sa USING (read_seq)""")
def j7(spark, d):
    lines = P.subset_reads(_cut_regions(spark, d), _sam_reads(spark, d), BIN)
    return lines.select("read_seq", F.split("line", "\t")[12].alias("sa"))


_MATES = """moved AS (SELECT ord, read_seq, chrom, text, GREATEST(1, start_pos - s + 1) AS pos,
  CASE read_seq % 4 WHEN 0 THEN '=' WHEN 1 THEN '*' WHEN 2 THEN 'chr' || (read_seq % 5 + 1) ELSE 'chr1:1-4000' END AS mate,
  CASE WHEN read_seq % 4 = 1 THEN 0 ELSE start_pos + 500 END AS mp, s, name, flags, cigar FROM kept),
placed AS (SELECT *, CASE WHEN mate IN ('=', '*') OR mate IN (SELECT text FROM named) THEN mate WHEN mate = chrom THEN text ELSE '*' END AS mate2,
  CASE WHEN mate = '=' OR mate = chrom THEN GREATEST(1, mp - s + 1) WHEN mate = '*' OR mate IN (SELECT text FROM named) THEN mp ELSE 0 END AS mp2 FROM moved)"""


@check("p14_rebase_reads", f"""{_CUT}, {_MATES} SELECT read_seq, text AS contig, CAST(pos AS VARCHAR) AS pos, mate2 AS mate,
  CAST(mp2 AS VARCHAR) AS mate_pos FROM placed""")
def p14(spark, d):
    f = F.split("line", "\t")
    lines = P.subset_reads(_cut_regions(spark, d), _sam_reads(spark, d), BIN)
    return lines.select(
        "read_seq", f[2].alias("contig"), f[3].alias("pos"), f[6].alias("mate"), f[7].alias("mate_pos")
    )


@check("q11_subset_reads", f"""{_CUT}, {_MATES}, {_SA} SELECT ord AS region_ord, read_seq, CONCAT_WS(chr(9), name, flags, text, pos, '60', cigar, mate2, mp2,
  '0', '*', '*', 'NM:i:1', CASE WHEN read_seq % 3 <> 0 THEN COALESCE(sa.sa, 'SA:Z:*') ELSE 'XX:Z:none' END, 'ZZ:i:7') AS line
FROM placed LEFT JOIN sa USING (read_seq)""")
def q11(spark, d):
    return P.subset_reads(_cut_regions(spark, d), _sam_reads(spark, d), BIN)
