"""Windows to assembly coordinates, and SV events, on the known scenarios."""

import random

import pytest
from helpers import blocks_df, expand_cigar, random_cigar, regions_df, rows_of, shuffled_bytes
from pyspark.sql import functions as F

from strandweave.functions import cigar as C
from strandweave.operators.cigar_index import explode_cigars, index_cigars, lookup_offsets
from strandweave.plans import mapping as M

HIT = ("region_id", "event_type", "ref_start", "ref_end", "asm_chrom", "asm_start", "asm_end")


def hits(spark, blocks, windows, min_mapq=0, **kw):
    return M.map_regions(regions_df(spark, windows), blocks_df(spark, blocks), min_mapq, bin_width=512, **kw)


def test_linear_projection_both_strands(spark):
    blocks = [
        ("chr1", 10000, 13000, "asm_chr1", 1000, 4000, "+", 60),
        ("chr1", 20000, 23000, "asm_chr1", 5000, 8000, "-", 50),
        ("chr2", 50000, 52000, "asm_chr2", 0, 2000, "+", 40),
    ]
    got = rows_of(
        hits(spark, blocks, [("chr1", 10500, 11000), ("chr1", 20000, 21000), ("chr2", 51000, 60000),
                             ("chr1", 14000, 15000), ("chrX", 0, 9), ("chr1", 11000, 11000)]), *HIT
    )
    assert got == [
        (0, "alignment", 10500, 11000, "asm_chr1", 1500, 2000),
        (1, "alignment", 20000, 21000, "asm_chr1", 7000, 8000),
        (2, "alignment", 51000, 52000, "asm_chr2", 1000, 2000),
    ]


def test_cigar_projection(spark):
    blocks = [
        ("chr1", 10000, 10200, "asm_chr1", 1000, 1195, "+", 60, "100M5D95M"),
        ("chr1", 20000, 20200, "asm_chr1", 2000, 2210, "+", 60, "100M10I100M"),
        ("chr2", 50000, 50200, "asm_chr2", 3000, 3195, "-", 60, "100M5D95M"),
    ]
    windows = [("chr1", 10000, 10200), ("chr1", 10000, 10102), ("chr1", 20050, 20150), ("chr2", 50000, 50100)]
    ops = explode_cigars(blocks_df(spark, blocks), ["sample_id", "hap", "block_seq"])
    for how in ({}, {"ops": ops}):
        got = rows_of(hits(spark, blocks, windows, **how), "region_id", "asm_start", "asm_end")
        assert got == [(0, 1000, 1195), (1, 1000, 1100), (2, 2050, 2160), (3, 3095, 3195)]


def test_insertion_at_window_edge(spark):
    blocks = [("chr13", 100, 115, "ctg_ins", 200, 265, "+", 60, "10=50I5=")]
    windows = [("chr13", 105, 113), ("chr13", 110, 115), ("chr13", 100, 110), ("chr13", 109, 115)]
    ops = explode_cigars(blocks_df(spark, blocks), ["sample_id", "hap", "block_seq"])
    for how in ({}, {"ops": ops}):
        got = rows_of(hits(spark, blocks, windows, **how), "region_id", "asm_start", "asm_end")
        assert got == [(0, 205, 263), (1, 260, 265), (2, 200, 210), (3, 209, 265)]


@pytest.mark.parametrize(
    "pair, kind, ref_gap, asm_gap",
    [
        ([("chr3", 1000, 2000, "c", 10000, 11000, "+", 60), ("chr3", 5000, 6000, "c", 11000, 12000, "+", 60)],
         "deletion", 3000, 0),
        ([("chr3", 10000, 11000, "c", 20000, 21000, "+", 60), ("chr3", 11000, 12000, "c", 31000, 32000, "+", 60)],
         "insertion", 0, 10000),
        ([("chr3", 20000, 21000, "c", 40000, 41000, "+", 60), ("chr3", 21000, 22000, "c", 41000, 42000, "-", 60)],
         "inversion", 0, None),
        ([("chr3", 30000, 31000, "a", 50000, 51000, "+", 60), ("chr3", 32000, 33000, "b", 60000, 61000, "+", 60)],
         "translocation", 1000, None),
        ([("chr14", 5000, 6000, "c", 1000, 2000, "+", 60), ("chr14", 6000, 7000, "c", 1500, 2500, "+", 60)],
         "complex", 0, -500),
        ([("chr5", 1000, 2000, "c", 9000, 10000, "-", 60), ("chr5", 7000, 8000, "c", 6000, 7000, "-", 60)],
         "deletion", 5000, 2000),
        ([("chr5", 1000, 2000, "c", 9000, 10000, "-", 60), ("chr5", 2000, 3000, "c", 4000, 5000, "-", 60)],
         "insertion", 0, 4000),
    ],
)
def test_gap_classes(spark, pair, kind, ref_gap, asm_gap):
    got = rows_of(M.sv_gaps(blocks_df(spark, pair)), "event_type", "ref_gap_size", "asm_gap_size", "mapq")
    assert got == [(kind, ref_gap, asm_gap, 60)]


def test_identical_reference_twice_gives_no_gap(spark):
    blocks = [("chr15", 100, 200, "c", 0, 100, "+", 60), ("chr15", 100, 200, "c", 300, 400, "+", 60)]
    assert [r[1] for r in rows_of(hits(spark, blocks, [("chr15", 0, 500)]), *HIT)] == ["alignment"] * 2


def test_min_mapq_changes_gaps(spark):
    blocks = [
        ("chr1", 100000, 105000, "c", 0, 5000, "+", 60),
        ("chr1", 100000, 105000, "d", 0, 5000, "+", 0),
        ("chr1", 110000, 115000, "c", 10000, 15000, "+", 20),
        ("chr1", 120000, 125000, "c", 20000, 25000, "+", 60),
    ]
    for level, n in ((0, 4), (1, 3), (30, 2), (60, 2), (61, 0)):
        got = rows_of(hits(spark, blocks, [("chr1", 99000, 126000)], level), *HIT)
        assert sum(r[1] == "alignment" for r in got) == n
        if level == 30:
            assert [(r[2], r[3]) for r in got if r[1] != "alignment"] == [(105000, 120000)]
    many = M.sv_gaps(blocks_df(spark, blocks), [0, 30, 61])
    got = rows_of(many, "min_mapq", "ref_start", "ref_end")
    one = lambda m: rows_of(M.sv_gaps(blocks_df(spark, blocks), m), "min_mapq", "ref_start", "ref_end")
    assert got == sorted(one(0) + one(30) + one(61))


def test_nested_block_makes_no_phantom_gap(spark):
    blocks = [
        ("chr11", 100, 1000, "c", 0, 900, "+", 60),
        ("chr11", 200, 300, "d", 0, 100, "+", 5),
        ("chr11", 400, 500, "c", 2000, 2100, "+", 60),
        ("chr11", 1200, 1300, "c", 900, 1000, "+", 60),
    ]
    got = rows_of(hits(spark, blocks, [("chr11", 0, 600), ("chr11", 0, 1500)]), "region_id", "event_type", "ref_start", "ref_end")
    assert [r for r in got if r[0] == 0 and r[1] != "alignment"] == []
    assert [r for r in got if r[0] == 1 and r[1] != "alignment"] == [(1, "deletion", 1000, 1200)]
    assert sum(r[0] == 1 and r[1] == "alignment" for r in got) == 4


def test_interleaving_contigs(spark):
    blocks = [
        ("chr12", 100, 500, "ctgX", 0, 400, "+", 60),
        ("chr12", 300, 800, "ctgY", 0, 500, "+", 60),
        ("chr12", 1000, 1200, "ctgX", 400, 600, "+", 60),
    ]
    got = rows_of(M.sv_gaps(blocks_df(spark, blocks)), "ref_start", "ref_end", "event_type")
    assert got == [(800, 1000, "translocation")]


def test_window_inside_gap_is_empty(spark):
    blocks = [("chr3", 0, 100, "c", 0, 100, "+", 60), ("chr3", 500, 600, "c", 100, 200, "+", 60)]
    assert rows_of(hits(spark, blocks, [("chr3", 200, 300), ("chr3", 50, 500), ("chr3", 50, 501)]), "region_id", "event_type") == [
        (1, "alignment"), (2, "alignment"), (2, "alignment"), (2, "deletion"),
    ]


def test_predecessor_is_the_same_however_bins_are_cut(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(400):
        s = rng.choice([rng.randint(0, 3000), 500])
        n = rng.randint(1, 200)
        rows.append((rng.choice(["a", "b"]), s, s + n, rng.choice("xy"), 5 * s, 5 * s + n, rng.choice("+-"), 60))
    expect = []
    for chrom in "ab":
        seen = sorted(((r[1], i, r) for i, r in enumerate(rows) if r[0] == chrom))
        best = None
        for _, i, r in seen:
            expect.append((i, best[0] if best else None))
            if best is None or r[2] > best[1]:
                best = (i, r[2])
    df = blocks_df(spark, rows)
    for width, split in ((1 << 20, 10**6), (64, 10**6), (256, 3), (1 << 20, 16)):
        got = M.with_predecessor(df, width, split).select("block_seq", "prev.block_seq").collect()
        assert sorted(map(tuple, got)) == sorted(expect)


def test_gaps_match_a_scan_of_each_window(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(120):
        s = rng.randrange(0, 2000, 10)
        n = rng.randrange(10, 120, 10)
        a = rng.randrange(0, 2000, 10)
        rows.append(("a", s, s + n, rng.choice("xy"), a, a + n, rng.choice("+-"), rng.choice([0, 30, 60])))
    windows = [("a", s, s + rng.randint(1, 600)) for s in (rng.randint(0, 2000) for _ in range(60))]
    expect = []
    for w, (_, lo, hi) in enumerate(windows):
        inside = sorted((r[1], i) for i, r in enumerate(rows) if r[1] < hi and r[2] > lo and r[7] >= 30)
        reach = None
        for _, i in inside:
            if reach is not None and rows[reach][2] < rows[i][1]:
                expect.append((w, rows[reach][2], rows[i][1]))
            if reach is None or rows[i][2] > rows[reach][2]:
                reach = i
    got = hits(spark, rows, windows, 30).filter("kind = 0 and ref_start < ref_end")
    assert rows_of(got, "region_id", "ref_start", "ref_end") == sorted(expect)


def test_projection_against_base_by_base_expansion(spark):
    rng = random.Random(3)
    rows, expect = [], []
    for i in range(300):
        cigar = random_cigar(rng, rng.randint(1, 12))
        bases, total = expand_cigar(cigar)
        if not bases:
            continue
        lo = rng.randrange(len(bases))
        hi = rng.randint(lo + 1, len(bases) + 3)
        a = bases[lo][0]
        b = bases[hi - 1][1] if hi <= len(bases) else total
        strand = rng.choice("+-")
        rows.append((i, cigar, lo, hi, strand, 1000, 1000 + total))
        expect.append((i, 1000 + a, 1000 + b) if strand == "+" else (i, 1000 + total - b, 1000 + total - a))
    df = spark.createDataFrame(rows, "id long, cigar string, lo long, hi long, strand string, s long, e long")
    args = [F.col(c) for c in ("strand", "s", "e")]
    walked = df.withColumn("o", C.block_offsets(F.col("cigar"), F.col("lo"), F.col("hi")))
    walked = walked.select("id", C.orient(F.col("o.lo"), F.col("o.hi"), *args).alias("p"))
    assert rows_of(walked, "id", "p.start", "p.end") == expect
    ops = explode_cigars(df, ["id"])
    found = lookup_offsets(df, ops, ["id"], bin_width=4)
    found = found.select("id", C.orient(F.col("q_lo"), F.col("q_hi"), *args).alias("p"))
    assert rows_of(found, "id", "p.start", "p.end") == expect


@pytest.mark.parametrize("width", [1, 4, 16, 4096])
def test_packed_index_against_walked_cigars(spark, width):
    """Every kind of operation, text that is none, ends past the operations, none at all, equal spans."""
    rng = random.Random(width)
    rows = [(0, "", 3, 9, 9), (1, "7I", 0, 2, 2), (2, "5S", 3, 4, 6), (3, "900N2M", 5, 901, 910), (4, None, 1, 2, 2), (5, "3Mx4?2D5I6M9S", 1, 14, 40)]
    for i in range(6, 400):
        cigar = random_cigar(rng, rng.randint(1, 40))
        n = max(len(expand_cigar(cigar)[0]), 1) + rng.randint(0, 5)
        lo = rng.randrange(n)
        rows += [(i, cigar, lo, rng.randint(lo + 1, n), n)] * rng.randint(1, 2)
    df = spark.createDataFrame(rows, "id long, cigar string, lo long, hi long, n long")
    walked = df.withColumn("o", C.block_offsets(F.col("cigar"), F.col("lo"), F.col("hi")))
    index = index_cigars(df.dropDuplicates(["id"]), ["id"], F.col("n"), width)
    assert index.groupBy("id", "cell").count().where("count > 1").isEmpty()
    found = lookup_offsets(df.drop("cigar"), index, ["id"], bin_width=width)
    assert rows_of(found, "id", "lo", "hi", "q_lo", "q_hi") == rows_of(walked, "id", "lo", "hi", "o.lo", "o.hi")


def test_packed_index_in_map_alignments(spark):
    blocks = [("chr13", 100, 115, "ctg_ins", 200, 265, "+", 60, "10=50I5="), ("chr2", 50000, 50200, "c", 3000, 3195, "-", 60, "100M5D95M")]
    windows = [("chr13", 105, 113), ("chr13", 110, 115), ("chr13", 100, 110), ("chr13", 109, 115), ("chr2", 50000, 50100)]
    ops = index_cigars(blocks_df(spark, blocks), ["sample_id", "hap", "block_seq"])
    got = rows_of(hits(spark, blocks, windows, ops=ops), "region_id", "asm_start", "asm_end")
    assert got == [(0, 205, 263), (1, 260, 265), (2, 200, 210), (3, 209, 265), (4, 3095, 3195)]


def test_packed_index_moves_little(spark):
    """A CIGAR is not moved to be cut, and a span in one bin is moved once."""
    blocks = spark.range(20_000).selectExpr("md5(concat('b', id)) as id", "concat(1 + id % 50, 'M2D3I', 1 + id % 60, 'M2X4M') as cigar", "40L as n")
    spans = spark.range(20_000).selectExpr("md5(concat('b', id)) as id", "id % 20 as lo", "id % 20 + 9 as hi")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "true"}
    kept = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        packed = shuffled_bytes(lookup_offsets(spans, index_cigars(blocks, ["id"], F.col("n"), 64), ["id"], bin_width=64))
        exploded = shuffled_bytes(lookup_offsets(spans, explode_cigars(blocks, ["id"]), ["id"], bin_width=64))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert packed < 0.5 * exploded


def test_translate_merges_by_contig_and_strand(spark):
    blocks = [
        ("chr1", 0, 100, "b", 0, 100, "+", 60),
        ("chr1", 100, 200, "b", 100, 200, "+", 60),
        ("chr1", 200, 300, "b", 150, 250, "-", 60),
        ("chr1", 300, 400, "a", 500, 600, "+", 60),
    ]
    wins = [("chr1", 0, 400), ("chr1", 0, 3_000_000), ("chr1", 9, 9), ("chr1", 10, 3), ("chr9", 0, 5)]
    got = M.translate(regions_df(spark, wins), blocks_df(spark, blocks), bin_width=64)
    hits = [("ok", "a", "+", 500, 600), ("ok", "b", "+", 0, 200), ("ok", "b", "-", 150, 250)]
    none = (None, None, None, None)
    assert rows_of(got, "region_id", "status", "asm_chrom", "strand", "start", "end") == [
        *[(0, *h) for h in hits], *[(1, *h) for h in hits], (2, "empty", *none), (3, "invalid", *none), (4, "unmapped", *none),
    ]
    small = M.translate(regions_df(spark, wins[:2]), blocks_df(spark, blocks), limit=1000, bin_width=64)
    assert rows_of(small, "region_id", "status")[-1] == (1, "too_large")


def test_annotations(spark):
    blocks = [("chr3", 0, 100, "c", 0, 100, "+", 60), ("chr3", 500, 600, "c", 100, 200, "+", 60)]
    got = M.sv_annotations(regions_df(spark, [("chr3", 0, 700)]), blocks_df(spark, blocks))
    assert rows_of(got, "label", "gap_size") == [("hap1: Deletion", 400)]


def test_predecessor_moves_blocks_once(spark):
    """However many thresholds, a block is moved once and without the value it stands for."""
    rng = random.Random(9)
    rows = [("chr%d" % (i % 2), i * 30, i * 30 + rng.randint(10, 60), "c%d" % rng.randint(0, 1), i * 30, i * 30 + 20, "+", rng.randint(0, 60))
            for i in range(20_000)]
    blocks = blocks_df(spark, rows)
    one = shuffled_bytes(M.with_predecessor(blocks, 4096))
    assert one < 100 * len(rows), one
    many = shuffled_bytes(M.sv_gaps(blocks, [0, 20, 50], 4096))
    assert many < 1.3 * one, (many, one)


def test_predecessor_of_crowded_and_other_bins(spark):
    """Some bins hold more rows than ``split_rows``, others do not; null keys and places take no part."""
    rng = random.Random(4)
    rows = [("chr1", p, p + rng.randint(1, 30), "c", 0, 9, "+", rng.choice([0, 30, 60]))
            for p in [*(rng.randint(0, 3) for _ in range(60)), *(rng.randint(64, 900) for _ in range(60))]]
    blocks = blocks_df(spark, rows).unionByName(blocks_df(spark, [(None, 1, 2, "c", 0, 9, "+", 60)]))
    prev = {r["block_seq"]: r["p"] for r in M.with_predecessor(blocks, 64, 10).select("block_seq", F.col("prev.block_seq").alias("p")).collect()}
    line = sorted((r[1], i) for i, r in enumerate(rows))
    best, expect = None, {}
    for start, i in line:
        expect[i] = best
        if best is None or rows[i][2] > rows[best][2]:
            best = i
    assert prev == expect
