"""Region text, phasing, intervals, coverage, lanes, k-mers and variants on known values."""

import random

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from strandweave.functions import dna
from strandweave.functions import regions as R
from strandweave.operators import coverage as cov
from strandweave.operators import intervals as I
from strandweave.operators import kmer_match as K
from strandweave.operators.cigar_index import cigar_features
from strandweave.operators.lanes import pack_lanes, pack_lanes_by_haplotype
from strandweave.operators.phasing import phase_counts, phase_reads, tag_reads
from strandweave.operators.variants import select_variants


def test_sizes_round_like_printf(spark):
    sizes = [0, 999, 1000, 1049, 1050, 1150, 1250, 1350, 1450, 1750, 2250, 999_949, 999_950, 1_000_000, 1_050_000,
             1_250_000, 1_350_000, 2_850_000, 123_450_000] + list(range(1050, 100_000, 700))

    def shown(bp):
        if bp >= 1_000_000:
            return f"{bp / 1_000_000:.1f} Mb"
        return f"{bp / 1000:.1f} kb" if bp >= 1000 else f"{bp} bp"

    df = spark.createDataFrame([(s,) for s in sizes], "bp long")
    assert [tuple(r) for r in df.select("bp", R.format_size(F.col("bp"))).collect()] == [(s, shown(s)) for s in sizes]


def test_region_text(spark):
    df = spark.createDataFrame([("chr1:10-20",), ("a:b:10-20",), ("chr1:1,000-2,000",), ("chr1",), ("chr1:9-3",)], "t string")
    got = df.select(*[f(F.col("t"))["valid"] for f in (R.parse_region, R.parse_region_greedy, R.parse_region_viewer)])
    assert [tuple(r) for r in got.collect()] == [
        (True, True, True), (False, True, False), (False, False, True), (False, False, False), (True, True, False),
    ]


def _reads(spark, rows, track):
    return spark.createDataFrame([(n, s, 4 if u else 0, track) for n, s, u in rows], "name string, as_score int, flags int, track string")


def test_phasing(spark):
    one = _reads(spark, [("a", 100, False), ("a", 90, False), ("b", 50, False), ("c", 70, False), ("e", 99, True), ("f", None, False), ("d", 80, False)], "hap1")
    two = _reads(spark, [("a", 80, False), ("b", 60, False), ("c", 70, False), ("g", 5, False), ("d", 75, False)], "hap2")
    phase = phase_reads(one, two, 5)
    assert rows_of(phase, "name", "hp") == [("a", 1), ("b", 2), ("c", 0), ("d", 0), ("g", 2)]
    assert tuple(phase_counts(phase).first()) == (1, 2, 2)
    assert tuple(phase_counts(phase.filter("hp = 1")).first()) == (1, 0, 0)
    old = spark.createDataFrame([("a", 2), ("z", 1), ("y", None)], "name string, hp int")
    once = tag_reads(old, phase)
    assert rows_of(once, "name", "hp") == [("a", 1), ("y", None), ("z", 1)]
    assert rows_of(tag_reads(once, phase), "name", "hp") == rows_of(once, "name", "hp")


@pytest.mark.parametrize("width", [1 << 20, 50])
def test_merge_and_cluster(spark, width):
    rng = random.Random(5)
    rows = [("k", s, s + rng.randint(1, 60)) for s in (rng.randint(0, 3000) for _ in range(150))] + [("j", 5, 9), ("j", 9, 12)]
    df = spark.createDataFrame(rows, "k string, start long, end long")

    def model(gap):
        out = []
        for k in "jk":
            groups = []
            for _, s, e in sorted(r for r in rows if r[0] == k):
                if groups and s <= max(groups[-1]) - 1 + 1 + gap:
                    groups[-1].update(range(s, e + 1))
                else:
                    groups.append(set(range(s, e + 1)))
            out += [(k, min(g), max(g)) for g in groups]
        return out

    assert rows_of(I.merge_intervals(df, ["k"], bin_width=width), "k", "start", "end") == model(0)
    clusters = I.cluster_intervals(df, ["k"], max_gap=20, bin_width=width)
    assert rows_of(clusters, "k", "start", "end") == model(20)
    bases = {b for _, s, e in rows[:150] for b in range(s, e)}
    assert clusters.filter("k = 'k'").agg(F.sum("covered")).first()[0] == len(bases)


def test_cluster_choice(spark):
    df = spark.createDataFrame(
        [(1, "ctgA", 100, 150), (1, "ctgA", 300, 350), (1, "ctgB", 1000, 1200), (2, "ctgA", 100, 200), (2, "ctgA", 500, 800), (2, "ctgB", 50, 120)],
        "r long, asm_chrom string, start long, end long",
    )
    best = I.best_cluster(I.cluster_intervals(df, ["r", "asm_chrom"]), ["r"])
    assert rows_of(best, "r", "asm_chrom", "start", "end", "pieces") == [(1, "ctgB", 1000, 1200, 1), (2, "ctgA", 100, 800, 2)]


def test_coverage(spark):
    view = spark.createDataFrame([(1, 100, 200)], "region_id long, view_start long, view_end long")
    read = "region_id long, view_start long, view_end long, start long, end long, hp int"
    one = spark.createDataFrame([(1, 100, 200, 100, 200, None)], read)
    got = cov.binned_coverage(view, one, 10)
    assert rows_of(got, "depth", "hap1_depth") == [(1, 0)] * 10
    three = spark.createDataFrame([(1, 100, 200, 100, 200, hp) for hp in (1, 2, None)], read)
    assert rows_of(cov.binned_coverage(view, three, 5), "depth", "hap1_depth", "hap2_depth") == [(3, 1, 1)] * 5
    off = spark.createDataFrame([(1, 100, 200, 300, 400, 1)], read)
    assert rows_of(cov.binned_coverage(view, off, 5), "depth") == [(0,)] * 5


def test_compare_sets(spark):
    sets = {"ref": "ABC", "hap1": "BD", "hap2": "CDE"}
    df = spark.createDataFrame([(1, t, n) for t, names in sets.items() for n in names], "region_id long, track string, name string")
    assert tuple(cov.compare_read_sets(df).first()) == (1, 1, 0, 1, 1, 1, 1, 0, 5)


def _lanes_by_scan(reads):
    ends, lanes = [], {}
    for start, seq, end in sorted(reads):
        best = min(range(len(ends)), key=lambda i: (ends[i], i), default=None)
        if best is None or start <= ends[best] + 5:
            best = len(ends)
            ends.append(end)
        ends[best] = end
        lanes[seq] = best
    return lanes


def test_lanes(spark):
    rng = random.Random(9)
    rows, expect, by_hp = [], {}, {}
    for region in range(12):
        starts = [rng.randint(1, 300) for _ in range(rng.randint(1, 60))]
        group = [(s, i, s + rng.randint(0, 40), rng.choice([1, 2, 0])) for i, s in enumerate(starts)]
        rows += [(region, i, s, e, hp) for s, i, e, hp in group]
        expect.update({(region, i): lane for i, lane in _lanes_by_scan([g[:3] for g in group]).items()})
        top = 0
        for pick in ({1}, {2}, {0, None}):
            part = [g[:3] for g in group if g[3] in pick]
            if part:
                top += top > 0
                lanes = _lanes_by_scan(part)
                by_hp.update({(region, i): top + lane for i, lane in lanes.items()})
                top += max(lanes.values()) + 1
    df = spark.createDataFrame(rows, "region_id long, read_seq long, start long, end long, hp int")
    got = {(r[0], r[1]): r[2] for r in pack_lanes(df, ["region_id"]).collect()}
    assert got == expect
    got = {(r[0], r[1]): r[2] for r in pack_lanes_by_haplotype(df, ["region_id"]).collect()}
    assert got == by_hp


def test_many_reads_keep_their_lanes_apart(spark):
    df = spark.range(10_000).selectExpr("1L AS region_id", "id AS read_seq", "id * 10 AS start", "id * 10 + 500 AS end")
    lanes = pack_lanes(df, ["region_id"])
    assert lanes.count() == 10_000 and lanes.agg(F.max("lane")).first()[0] == 50


def test_features_of_a_read(spark):
    df = spark.createDataFrame([(1, 100, "2H5S10M3I2X4D6M7S"), (2, 50, "*")], "read_seq long, start long, cigar string")
    r = {x["read_seq"]: x for x in cigar_features(df, ["read_seq"]).collect()}
    assert [tuple(x) for x in r[1]["indels"]] == [(110, 3, "insertion"), (112, 4, "deletion")]
    assert [x["ref_pos"] for x in r[1]["mismatches"]] == [110, 111]
    assert [tuple(x) for x in r[1]["soft_clips"]] == [(100, 5, True), (122, 7, False)]
    assert r[2]["indels"] == r[2]["mismatches"] == r[2]["soft_clips"] == []


def test_kmer_matches(spark):
    rng = random.Random(1)
    pairs = [("p%d" % i, "".join(rng.choice("ACGTN") for _ in range(n)), "".join(rng.choice("ACGT") for _ in range(m)))
             for i, (n, m) in enumerate([(40, 30), (1500, 20), (3, 50), (0, 9)])]
    df = spark.createDataFrame(pairs, "pair_id string, seq1 string, seq2 string")
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for k, cap in ((4, 10**6), (3, 17)):
        expect = []
        for name, a, b in pairs:
            found = []
            for i in range(len(a) - k + 1):
                x = a[i:i + k]
                if "N" in x:
                    continue
                same = [(name, i, j, 2 if x == rc(x) else 1) for j in range(len(b) - k + 1) if b[j:j + k] == x]
                turned = [(name, i, j, -1) for j in range(len(b) - k + 1) if b[j:j + k] == rc(x) != x]
                found += same + turned
            expect += found[:cap]
        got = K.dotplot_matches(df, k, cap)
        assert rows_of(got, "pair_id", "i", "j", "match_type") == sorted(expect)
        flags = {r["pair_id"]: r["truncated"] for r in K.dotplot_summary(df, k, cap).collect()}
        if cap == 10**6:
            every = rows_of(K.dotplot_matches(df, k), "pair_id", "i", "j", "match_type")
            assert every == sorted(expect)
            kinds = {r["pair_id"]: (r["forward"], r["reverse"], r["palindrome"]) for r in K.dotplot_summary(df, k).collect()}
            of = lambda n, t: sum(e[0] == n and e[3] == t for e in expect)
            assert kinds == {n: (of(n, 1), of(n, -1), of(n, 2)) for n, _, _ in pairs}
        assert flags == {n: sum(e[0] == n for e in expect) >= cap for n, _, _ in pairs}
    with pytest.raises(ValueError):
        K.dotplot_matches(df, 0)
    one = spark.createDataFrame([("AcGtN",)], "s string").select(dna.reverse_complement(F.col("s")))
    assert one.first()[0] == "NaCgT"


def _matches_by_hand(name, a, b, k):
    rc = lambda s: s[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))
    out = []
    for i in range(len(a) - k + 1):
        x = a[i:i + k]
        if "N" not in x:
            out += [(name, i, j, 2 if x == rc(x) else 1) for j in range(len(b) - k + 1) if b[j:j + k] == x]
            out += [(name, i, j, -1) for j in range(len(b) - k + 1) if b[j:j + k] == rc(x) != x]
    return out


def test_kmer_matches_short_and_long(spark, monkeypatch):
    """Pairs matched in their task and pairs joined by k-mer give the same, for odd letters and long k-mers too."""
    monkeypatch.setattr(K, "WHOLE", 60)
    monkeypatch.setattr(K, "BATCH", 7)
    rng = random.Random(5)
    word = "".join(rng.choice("ACGTacgtN\u00e9\U0001f9ecxyzw") for _ in range(45)) + "ACGT" * 18
    pairs = [("short", "AATTGC" * 9, "GCAATT" * 9), ("long", "AATTGC" * 12, "GCAATT" * 9), ("odd", "x" + word[:50], word[:50]),
             ("oddlong", "x" + word, word), ("none", None, "ACGT"), ("empty", "", "")]
    df = spark.createDataFrame(pairs, "pair_id string, seq1 string, seq2 string")
    for k in (1, 4, 23, 40):
        expect = [_matches_by_hand(n, a or "", b or "", k) for n, a, b in pairs]
        assert rows_of(K.dotplot_matches(df, k), "pair_id", "i", "j", "match_type") == sorted(sum(expect, []))
        assert rows_of(K.dotplot_matches(df, k, 9), "pair_id", "i", "j", "match_type") == sorted(sum((e[:9] for e in expect), []))
        kinds = {r["pair_id"]: (r["forward"], r["reverse"], r["palindrome"]) for r in K.dotplot_summary(df, k).collect()}
        assert kinds == {p[0]: tuple(sum(x[3] == t for x in e) for t in (1, -1, 2)) for p, e in zip(pairs, expect, strict=True)}


def test_kmer_matches_do_not_shuffle_kmers(spark):
    """What moves are the texts of the pairs: no exchange lies above the matching of short ones."""
    df = spark.createDataFrame([("p", "ACGT" * 30, "CGTA" * 30)], "pair_id string, seq1 string, seq2 string")
    plan = K.dotplot_matches(df, 5, 10)._jdf.queryExecution().executedPlan().toString()
    short = plan[:plan.index("MapInArrow")]
    assert "Exchange" not in short


def test_shingle_extent(spark):
    """Sums of each piece, and no sort of k-mers below the final grouping."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ACGTN" if i else "N") for _ in range(n))) for i, n in enumerate((40, 1700, 513, 3, 512))]
    df = spark.createDataFrame(rows, "doc_id long, seq string")
    k = K.shingle(df, 5, "seq", "pos", ("doc_id",)).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("kmer").alias("lo"), F.max("kmer").alias("hi"), F.sum("pos").alias("places"))
    cols = ("doc_id", "n", "lo", "hi", "places")
    assert rows_of(K.shingle_extent(df, 5, "seq", ("doc_id",)), *cols) == rows_of(k, *cols)


def test_selection_keeps_all_when_few(spark):
    rows = [(0, "a", 5, 10), (1, "a", 5, 30), (2, "b", 1, 20), (3, "a", 9, 25)]
    df = spark.createDataFrame(rows, "var_seq long, chrom string, pos long, size long")
    pick = lambda k: [r["var_seq"] for r in select_variants(df, k).collect()]
    assert pick(4) == [1, 3, 2, 0]
    assert pick(3) == [1, 3, 2]
    assert pick(1) == [1]
    assert pick(2) == [1, 2]


def test_coverage_fills_views_without_grouping_bins(spark):
    """Bins become rows in the result only; views without reads and short views have all bins."""
    rng = random.Random(8)
    views = [(i, s, s + rng.randint(1, 90)) for i, s in enumerate(rng.randint(1, 400) for _ in range(40))]
    reads = [(*rng.choice(views[:30]), s, s + rng.randint(0, 60), rng.choice([None, 0, 1, 2])) for s in (rng.randint(1, 480) for _ in range(200))]
    kind = "region_id long, view_start long, view_end long"
    got = cov.binned_coverage(spark.createDataFrame(views, kind), spark.createDataFrame(reads, kind + ", start long, end long, hp int"), 7)
    expect = []
    for v, vs, ve in views:
        size = max(1, -(-(ve - vs) // 7))
        depth = [[0] * 7 for _ in range(3)]
        for r, _, _, s, e, hp in reads:
            if r == v and e >= vs and s <= ve:
                for b in range((max(s, vs) - vs) // size, min(max(min(e, ve) - vs - 1, 0) // size, 6) + 1):
                    depth[0][b] += 1
                    if hp in (1, 2):
                        depth[hp][b] += 1
        expect += [(v, b, vs + b * size, min(vs + (b + 1) * size, ve), *(d[b] for d in depth)) for b in range(7)]
    assert rows_of(got, "region_id", "bin", "bin_start", "bin_end", "depth", "hap1_depth", "hap2_depth") == expect
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_islands_are_spread_over_more_partitions_than_usual(spark):
    """A task sorts and groups what it holds; copies of one interval are reduced before they move."""
    df = spark.range(4000, numPartitions=2).select(F.lit(None).cast("string").alias("k"), (F.col("id") % 40 * 10).alias("start"), (F.col("id") % 40 * 10 + 5 + F.floor(F.col("id") / 3999)).alias("end"))
    got = I.islands(df, ["k"], bin_width=64)
    # 39 starts of 10 apart and the last copy, one longer; bins cut nothing that does not go on.
    assert rows_of(got, "start", "end") == [(i * 10, i * 10 + 5 + (i == 39)) for i in range(40)]
    assert got.rdd.getNumPartitions() == I.SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
