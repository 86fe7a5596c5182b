"""Readers and writers: tables are written as text, read back and compared with the table.

Files go to a new scratch folder of the session for every run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sql as S
from checks import views as V
from checks.mapping_queries import HITS, _text
from checks.registry import check
from checks.views import ctes
from strandweave.operators.overlap import position_bin
from strandweave.operators.sequences import chunk_sequences
from strandweave.plans import mapping as M
from strandweave.plans.phasing import phase_and_tag
from strandweave.plans.subset import subset_parts, subset_sequences, variant_manifest
from strandweave.session import scratch_folder
from strandweave.sources.lookup import open_lookup
from strandweave.sources import alignments, paf, regions, samples, sequences, writers

BIN = 256
BLOCK = "ref_chrom, ref_start, ref_end, asm_chrom, asm_start, asm_end, strand, mapq"


def _paf(spark, d, label, only=None, in_order=False):
    """Blocks as PAF text with a comment, a short line, repeated tags and a colon in a tag.

    A file has no block numbers but its lines. Where these decide, as between
    blocks of one start, lines are written ``in_order`` of the table's numbers.
    """
    b = V.blocks(spark, d)
    b = b if only is None else b.filter(F.col("hap") == only)
    b = b.orderBy(*S.ORDER.split(", ")) if in_order else b
    text = lambda *cs: [F.col(c).cast("string") for c in cs]
    row = F.concat_ws(
        "\t", "asm_chrom", F.lit("999999999"), *text("asm_start", "asm_end"), "strand", "ref_chrom", F.lit("999999999"),
        *text("ref_start", "ref_end", "matches", "block_len", "mapq"), F.lit("cg:Z:1M"), F.lit("zz:Z:a:b:c"),
        F.when(F.col("block_seq") % 3 != 0, F.concat(F.lit("tp:A:P\tcg:Z:"), "cigar")), F.lit("bad"),
    )
    lines = F.array(F.lit("# a comment"), F.lit("too\tshort"), row)
    keep = F.when(F.col("block_seq") % 100 == 0, lines).otherwise(F.array(row))
    path = scratch_folder(spark, label)
    b.select(F.explode(keep).alias("value")).write.text(path, compression="gzip")
    return path


@check("s1_read_paf", f"""{ctes('blocks')} SELECT {BLOCK}, matches, block_len FROM blocks""")
def s1(spark, d):
    return paf.read_paf(spark, _paf(spark, d, "s1")).select(*BLOCK.split(", "), "matches", "block_len")


@check("s2_paf_tags", f"""{ctes('blocks')} SELECT ref_chrom, ref_start, CASE WHEN block_seq % 3 <> 0 THEN cigar ELSE '1M' END AS cigar,
  CASE WHEN block_seq % 3 <> 0 THEN 'P' ELSE '' END AS tp FROM blocks""")
def s2(spark, d):
    return paf.read_paf(spark, _paf(spark, d, "s2")).select("ref_chrom", "ref_start", "cigar", "tp")


@check("s12_several_pafs", f"""{ctes('blocks')} SELECT hap, ref_chrom, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(ref_start) AS BIGINT) AS total
FROM blocks GROUP BY ALL""")
def s12(spark, d):
    """Two inputs in argument order; the order number tells which one a block came from."""
    paths = [_paf(spark, d, "s12a", "hap1"), _paf(spark, d, "s12b", "hap2")]
    both = paf.read_paf(spark, paths)
    n_first = len(spark.read.text(paths[0]).inputFiles())
    hap = F.when(F.shiftright("block_seq", 44) < n_first, "hap1").otherwise("hap2")
    return both.groupBy(hap.alias("hap"), "ref_chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("ref_start").alias("total"))


@check("s3_mapping_json", f"""{ctes('blocks')} SELECT hap, {BLOCK}, cigar, tp FROM blocks""")
def s3(spark, d):
    """A document holds one assembly, so each haplotype has its own."""
    back = []
    for hap in ("hap1", "hap2"):
        path = scratch_folder(spark, "s3")
        writers.write_mapping_json(V.blocks(spark, d).filter(F.col("hap") == hap), path)
        back.append(paf.read_mapping_json(spark, path).select(F.lit(hap).alias("hap"), *BLOCK.split(", "), "cigar", "tp"))
    return back[0].unionByName(back[1])


@check("k1_mapping_bed", f"""{ctes('blocks')} SELECT ref_chrom, ref_start, ref_end, asm_chrom, asm_start, asm_end, strand, mapq, block_len, matches FROM blocks""")
def k1(spark, d):
    path = scratch_folder(spark, "k1")
    writers.write_mapping_bed(V.blocks(spark, d), path)
    schema = ("ref_chrom string, ref_start long, ref_end long, asm_chrom string, asm_start long, asm_end long, "
              "strand string, mapq int, block_len long, matches long")
    return spark.read.csv(path, sep="\t", schema=schema)


@check("k2_block_store", f"""{ctes('blocks')} SELECT hap, {BLOCK}, block_seq, matches, block_len, cigar, tp FROM blocks""")
def k2(spark, d):
    path = scratch_folder(spark, "k2")
    writers.write_blocks(V.blocks(spark, d), path)
    return paf.read_blocks(spark, path).select("hap", *BLOCK.split(", "), "block_seq", "matches", "block_len", "cigar", "tp")


@check("k3_hits_tsv", f"""{ctes('blocks', 'windows')}, {S.kept(0)}, {S.PREV}, {S.PFIELDS}, {S.GAPS}, {S.PAIRS}, {S.PROJECTED}, {S.SEEN_GAPS}
SELECT ref_chrom, ref_start, ref_end, asm_chrom, asm_start, asm_end, strand, mapq, event_type
FROM (SELECT {HITS} FROM aligned UNION ALL SELECT {HITS} FROM seen)""")
def k3(spark, d):
    path = scratch_folder(spark, "k3")
    writers.write_hits_tsv(M.map_regions(V.windows(spark, d), V.blocks(spark, d), bin_width=BIN), path)
    schema = ("ref_chrom string, ref_start long, ref_end long, asm_chrom string, asm_start long, asm_end long, "
              "strand string, mapq int, event_type string")
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


@check("q1_build_mapping", f"""{ctes('blocks')} SELECT hap, ref_chrom, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(ref_end - ref_start) AS BIGINT) AS bases,
  MIN(ref_start) AS lo, MAX(ref_end) AS hi FROM blocks GROUP BY ALL""")
def q1(spark, d):
    one, two = (
        M.build_mapping(spark, [_paf(spark, d, "q1", hap)], scratch_folder(spark, "q1"), "s0", hap) for hap in ("hap1", "hap2")
    )
    return one.unionByName(two).groupBy("hap", "ref_chrom").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("ref_end") - F.col("ref_start")).alias("bases"),
        F.min("ref_start").alias("lo"), F.max("ref_end").alias("hi"),
    )


@check("q1_lookup_tables", f"""{ctes('blocks')}, levels AS (SELECT UNNEST([0, 15, 40, 70]) AS level),
kept AS (SELECT b.* EXCLUDE (hap), b.hap || ':' || l.level AS hap FROM blocks b JOIN levels l ON b.mapq >= l.level), {S.PREV}, {S.PFIELDS}, {S.GAPS}
SELECT 'blocks' AS kind, hap, ref_chrom, 0 AS level, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(ref_end - ref_start) AS BIGINT) AS bases FROM blocks GROUP BY ALL
UNION ALL SELECT 'ops', hap, ref_chrom, 0, CAST(COUNT(*) AS BIGINT), CAST(SUM(CASE WHEN block_seq % 3 <> 0 THEN ref_end - ref_start ELSE 1 END) AS BIGINT) FROM blocks GROUP BY ALL
UNION ALL SELECT 'gaps', SPLIT_PART(hap, ':', 1), ref_chrom, CAST(SPLIT_PART(hap, ':', 2) AS INTEGER), CAST(COUNT(*) AS BIGINT),
  CAST(SUM(ref_gap_size) AS BIGINT) FROM gaps GROUP BY ALL""")
def q1_tables(spark, d):
    """What ``build_mapping`` stores for lookups: blocks, CIGAR entries and the gaps of four thresholds."""
    parts = []
    for hap in ("hap1", "hap2"):
        out = scratch_folder(spark, "q1")
        M.build_mapping(spark, [_paf(spark, d, "q1", hap, in_order=True)], out, "s0", hap, bin_width=256, buckets=4)
        found = open_lookup(spark, f"{out}/lookup")
        levels = F.explode(F.array(*[F.lit(m) for m in (0, 15, 40, 70)]))
        gaps = found.gaps.withColumn("level", levels).where("level <= upto and (over is null or level > over)")
        tables = {
            "blocks": (found.blocks.where("bin = first_bin").withColumn("level", F.lit(0)), F.col("ref_end") - F.col("ref_start")),
            "ops": (found.ops.where(F.col("bin") == position_bin(F.col("entry_start"), found.bin_width)).withColumn("level", F.lit(0)), F.col("entry_end") - F.col("entry_start")),
            "gaps": (gaps, F.col("ref_gap_size")),
        }
        parts += [df.groupBy(F.lit(kind).alias("kind"), "hap", "ref_chrom", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bases"))
                  for kind, (df, size) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


# --- reads ---------------------------------------------------------------------------

def _sam(spark, d, label):
    r = V.reads(spark, d)
    text = lambda c: F.col(c).cast("string")
    line = F.concat_ws(
        "\t", "name", text("flags"), "chrom", text("start"), F.coalesce(text("mapq"), F.lit("255")), "cigar", F.lit("*"),
        F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("NM:i:1"),
        F.when(F.col("hp").isNotNull(), F.concat(F.lit("HP:i:"), text("hp"))),
        F.when(F.col("as_score").isNotNull(), F.concat(F.lit("AS:i:"), text("as_score"))),
    )
    lines = F.when(
        F.col("read_seq") % 50 == 0, F.array(F.lit("@HD\tVN:1.6"), F.lit("@SQ\tSN:chr1\tLN:9"), F.lit("x\ty"), line)
    ).otherwise(F.array(line))
    path = scratch_folder(spark, label)
    r.select(F.explode(lines).alias("value")).write.text(path)
    return path


@check("s4_alignments", f"""{ctes('reads')} SELECT name, chrom, start_pos, end_pos, (flags & 16) <> 0 AS is_reverse,
  CAST(mapq AS VARCHAR) AS mapq, CAST(hp AS VARCHAR) AS hp, flags, cigar, CAST(as_score AS VARCHAR) AS as_score FROM reads WHERE (flags & 4) = 0""")
def s4(spark, d):
    back = alignments.read_sam(spark, _sam(spark, d, "s4"), "s0", "ref")
    back = back.select("name", "chrom", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "is_reverse",
                       "mapq", "hp", "flags", "cigar", "as_score")
    return _text(back, "mapq", "hp", "as_score")


@check("k4_tagged_reads", f"""{ctes('reads')}, sc AS (SELECT * FROM reads WHERE (flags & 4) = 0 AND as_score IS NOT NULL),
h1 AS (SELECT name, MAX(as_score) AS s1 FROM sc WHERE track = 'hap1' GROUP BY name),
h2 AS (SELECT name, MAX(as_score) AS s2 FROM sc WHERE track = 'hap2' GROUP BY name),
phase AS (SELECT name, CASE WHEN s2 IS NULL THEN 1 WHEN s1 IS NULL THEN 2 WHEN s1 > s2 THEN 1 WHEN s1 < s2 THEN 2 ELSE 0 END AS hp FROM h1 FULL JOIN h2 USING (name))
SELECT read_seq, track, CAST(COALESCE(p.hp, r.hp) AS VARCHAR) AS hp FROM reads r LEFT JOIN phase p USING (name)""")
def k4(spark, d):
    path = scratch_folder(spark, "k4")
    writers.write_tagged_reads(phase_and_tag(V.reads(spark, d))[2], path)
    return _text(spark.read.parquet(path).select("read_seq", "track", "hp"), "hp")


# --- variants and manifests ------------------------------------------------------------

def _vcf(spark, d, label, gz=False):
    v = V.variants(spark, d)
    n = F.col("var_seq")
    info = F.when(n % 4 == 0, F.concat(F.lit("SVTYPE=DEL;SVLEN=-"), (F.col("size") + 7).cast("string"))).when(
        n % 4 == 1, "SVLEN=x;AC=1"
    ).otherwise("AC=2")
    line = F.concat_ws(
        "\t", "chrom", F.col("pos").cast("string"), F.lit("."), F.repeat(F.lit("A"), (F.col("size") + 1).cast("int")), F.lit("A"),
        F.lit("."), F.lit("PASS"), info, F.lit("GT:DP"), F.concat("genotype", F.lit(":12")),
    )
    lines = F.when(n % 90 == 0, F.array(F.lit("##header"), F.lit("chr1\t5"), line)).otherwise(F.array(line))
    path = scratch_folder(spark, label) + (".vcf.gz" if gz else ".vcf")
    v.select(F.explode(lines).alias("value")).write.text(path, **({"compression": "gzip"} if gz else {}))
    return path


@check("s5_vcf_deletions", f"""{ctes('variants')} SELECT chrom, pos, pos + size + 1 AS end_pos, size, gt AS genotype
FROM variants WHERE size >= 1000 AND CONTAINS(gt, '1')""")
def s5(spark, d):
    v = regions.read_vcf_deletions(spark, _vcf(spark, d, "s5"))
    return v.select("chrom", "pos", F.col("end").alias("end_pos"), "size", "genotype")


_VCF_REGIONS = f"""{ctes('variants')}, v AS (SELECT *, CASE WHEN var_seq % 4 = 0 THEN size + 7 ELSE size END AS sz, REPLACE(gt, '/', '|') AS g FROM variants)
SELECT chrom, pos AS start_pos, pos + sz AS end_pos, chrom || ':' || pos || '-' || (pos + sz) AS ref_region, sz AS size, g AS genotype,
  chrom || ':' || pos || '-' || (pos + sz) || ' (' || CASE WHEN sz >= 1000 THEN FORMAT('{{:.1f}} kb', CAST(sz AS DOUBLE) / 1000) ELSE sz || ' bp' END
  || ', ' || g || ')' AS label FROM v WHERE sz >= 500"""


def _region_columns(df):
    return df.select("chrom", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "ref_region", "size", "genotype", "label")


@check("s6_vcf_regions", _VCF_REGIONS)
def s6(spark, d):
    return _region_columns(regions.read_vcf_regions(spark, _vcf(spark, d, "s6")))


@check("s8_regions_by_extension", _VCF_REGIONS)
def s8(spark, d):
    found = regions.read_regions(spark, _vcf(spark, d, "s8", gz=True))
    return _region_columns(found.unionByName(regions.read_regions(spark, "/nowhere/x.vcf")).unionByName(regions.read_regions(spark, "y.txt")))


@check("s7_manifest", f"""{ctes('variants')} SELECT chrom, CASE WHEN var_seq % 5 = 0 THEN 8 ELSE pos END AS start_pos,
  CASE WHEN var_seq % 5 = 0 THEN 90 ELSE pos + size END AS end_pos,
  CASE WHEN var_seq % 3 = 0 THEN chrom || ':1-9' WHEN var_seq % 5 = 0 THEN chrom || ':8-90' END AS fasta_region, gt AS genotype,
  CASE WHEN var_seq % 10 = 0 THEN 82 ELSE size END AS size FROM variants""")
def s7(spark, d):
    """One manifest per line, each of one variant, some without a position."""
    v = V.variants(spark, d)
    n = F.col("var_seq")
    one = F.struct(
        "chrom", F.when(n % 5 != 0, F.col("pos")).alias("pos"), F.when(n % 10 != 0, F.col("size")).alias("size"), "genotype",
        F.when(n % 5 == 0, F.concat("chrom", F.lit(":8-90"))).alias("ref_region"),
        F.when(n % 3 == 0, F.concat("chrom", F.lit(":1-9"))).alias("fasta_region"),
    )
    path = scratch_folder(spark, "s7")
    v.select(F.lit("x").alias("description"), F.array(one).alias("variants")).write.json(path)
    back = regions.read_manifest(spark, path, multi_line=False)
    return back.select("chrom", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "fasta_region", "genotype", "size")


@check("k5_manifest", f"""{ctes('variants')}, tops AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chrom ORDER BY size DESC, var_seq) AS rn FROM variants),
picked AS (SELECT * FROM tops WHERE rn = 1 ORDER BY size DESC, var_seq LIMIT 20)
SELECT chrom, pos, size, gt AS genotype, chrom || ':' || pos || '-' || (pos + size) AS ref_region,
  chrom || ':' || GREATEST(0, pos - 50000) || '-' || (pos + size + 50001) AS fasta_region FROM picked""")
def k5(spark, d):
    """The manifest of the 20 chosen variants, written as one document and read back."""
    path = scratch_folder(spark, "k5")
    chosen = variant_manifest(V.variants(spark, d), V.blocks(spark, d), "s0", 20, bin_width=65_536)
    writers.write_manifest(chosen, path, "chosen")
    back = regions.read_manifest_variants(spark, path)
    return back.select("chrom", "pos", "size", "genotype", "ref_region", "fasta_region")


# --- sequences and samples ----------------------------------------------------------------

def _fasta(spark, d, label):
    """Records whose headers hold the mark that starts a record."""
    s = V.seqs(spark, d)
    body = F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n")
    path = scratch_folder(spark, label)
    s.select(F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" made from text, A->B\n"), body).alias("value")).write.text(path)
    return path


@check("s9_fasta", f"""{ctes('seqs')} SELECT 'd' || doc_id AS name, seq FROM seqs""")
def s9(spark, d):
    return sequences.read_fasta(spark, _fasta(spark, d, "s9")).select("name", "seq")


@check("s9_fasta_chunks", f"""{ctes('seqs')}, c AS (SELECT doc_id, seq, UNNEST(RANGE(GREATEST(1, CAST(CEIL(LENGTH(seq) / 700.0) AS BIGINT)))) AS chunk FROM seqs)
SELECT 'd' || doc_id AS name, CAST(chunk AS INTEGER) AS chunk, SUBSTRING(seq, chunk * 700 + 1, 700) AS bases FROM c""")
def s9_chunks(spark, d):
    return sequences.read_fasta_chunks(spark, _fasta(spark, d, "s9c"), size=700).drop("genome")


@check("s10_fai", f"""{ctes('seqs')} SELECT 'd' || doc_id AS name, CAST(LENGTH(seq) AS BIGINT) AS length FROM seqs""")
def s10(spark, d):
    s = V.seqs(spark, d)
    line = F.concat_ws("\t", F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.length("seq").cast("string"), F.lit("7\t60\t61"))
    path = scratch_folder(spark, "s10")
    s.select(line.alias("value")).write.text(path)
    return sequences.read_fai(spark, path).select("name", "length")


@check("k6_fasta_subset", f"""{ctes('seqs')} SELECT 'd' || doc_id || ':3-' || (90 + doc_id % 50) AS name,
  SUBSTRING(seq, 3, CAST(88 + doc_id % 50 AS BIGINT)) AS seq FROM seqs WHERE LENGTH(seq) > 2""")
def k6(spark, d):
    s = V.seqs(spark, d)
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    chunks = chunk_sequences(s.select(F.lit("g").alias("genome"), name.alias("name"), "seq"), 64)
    asked = s.filter(F.length("seq") > 2).select(
        F.col("doc_id").alias("ord"), F.lit("g").alias("genome"), name.alias("chrom"),
        F.lit(3).cast("bigint").alias("start"), (90 + F.col("doc_id") % 50).alias("end"),
    )
    path = scratch_folder(spark, "k6")
    writers.write_fasta(subset_sequences(asked, chunks, 64), path)
    return sequences.read_fasta(spark, path).select("name", "seq")


@check("k6_wrapped_fasta", f"""{ctes('seqs')}, cut AS (SELECT doc_id, SUBSTRING(seq, 3, CAST(898 + doc_id % 50 AS BIGINT)) AS s FROM seqs WHERE LENGTH(seq) > 2)
SELECT line, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT '>d' || doc_id || ':3-' || (900 + doc_id % 50) AS line FROM cut
  UNION ALL SELECT SUBSTRING(s, CAST(i * 60 + 1 AS BIGINT), 60) FROM (SELECT s, UNNEST(RANGE(CAST(CEIL(LENGTH(s) / 60.0) AS BIGINT))) AS i FROM cut)) GROUP BY line""")
def k6_wrapped(spark, d):
    """The lines of a FASTA file whose records were written part by part."""
    s = V.seqs(spark, d)
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    chunks = chunk_sequences(s.select(F.lit("g").alias("genome"), name.alias("name"), "seq"), 100)
    asked = s.filter(F.length("seq") > 2).select(
        F.col("doc_id").alias("ord"), F.lit("g").alias("genome"), name.alias("chrom"),
        F.lit(3).cast("bigint").alias("start"), (900 + F.col("doc_id") % 50).alias("end"),
    )
    path = scratch_folder(spark, "k6")
    writers.write_fasta_parts(subset_parts(asked, chunks, 100, 240), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@check("s11_sample_sheet", """SELECT c_name AS sample_id, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'r' || c_custkey || '.bam' END AS reads_bam,
  CASE WHEN c_custkey % 2 = 0 THEN 'r' || c_custkey || '.cram' ELSE '' END AS reads_cram,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS cohort FROM customer""")
def s11(spark, d):
    c = V.table(spark, d, "customer")
    n, k = F.col("c_custkey"), F.col("c_custkey").cast("string")
    bam = F.concat(F.lit("r"), k, F.when(n % 2 == 0, ".cram").otherwise(".bam"))
    line = F.concat_ws("\t", "c_name", bam, F.when(n % 3 != 0, F.col("c_mktsegment")))
    head = F.lit("#sample_id\treads_bam\tcohort")
    path = scratch_folder(spark, "s11")
    # Every part file starts with the header; the later ones count as comments.
    lines = c.select(F.monotonically_increasing_id().alias("i"), line.alias("line")).select(
        F.explode(F.when(F.col("i").bitwiseAND(F.lit((1 << 33) - 1)) == 0, F.array(head, "line")).otherwise(F.array("line"))).alias("value")
    )
    lines.write.text(path)
    return samples.read_sample_sheet(spark, path)
