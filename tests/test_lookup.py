import random

from pyspark.sql import functions as F

from strandweave.functions import cigar as C
from strandweave.operators import intervals as I
from strandweave.operators.cigar_index import cigar_features
from strandweave.operators.quality_gaps import Frontier
from strandweave.plans import mapping as M
from strandweave.session import scratch_folder
from strandweave.sources.lookup import open_lookup
from tests.helpers import BLOCKS, blocks_df, random_cigar, regions_df, rows_of

HITS = [c for c in M.HITS if c != "block_seq"]


def many_blocks(seed=1, n=400):
    """Blocks that share starts, qualities and reaches, with CIGARs of up to 300 operations or none."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        start = rng.randrange(0, 3000, 10)
        cigar = rng.choice(["", random_cigar(rng, rng.choice([1, 5, 64, 65, 300]))])
        size = rng.choice([10, 30, 200, 900])
        a = rng.randrange(5000)
        rows.append((rng.choice(["chr1", "chr2"]), start, start + size, rng.choice("ab"), a, a + size, rng.choice("+-"), rng.choice([0, 7, 30, 60, 60, 255]), cigar))
    return rows


def two_samples(spark):
    return blocks_df(spark, many_blocks(1), "s", "hap1").union(blocks_df(spark, many_blocks(2), "s", "")).union(blocks_df(spark, many_blocks(3), "t", "hap1"))


def asked(spark):
    rng, rows = random.Random(5), []
    for i in range(80):
        start = rng.randrange(-50, 3500)
        rows.append((i, rng.choice("st"), rng.choice(["chr1", "chr2", "chr9"]), start, start + rng.choice([0, 1, 40, 700, 5000]), rng.choice([None, -3, 0, 8, 60, 61, 300])))
    return spark.createDataFrame(rows, "region_id long, sample_id string, chrom string, start long, end long, min_mapq int")


def test_gaps_of_every_threshold_in_one_pass(spark):
    blocks = two_samples(spark)
    for run_rows, levels in ((4, (-1, 0, 8, 60, 61)), (1 << 16, (7, 256))):
        found = M.quality_gaps(blocks, run_rows).cache()
        for level in levels:
            here = found.where((F.col("upto") >= level) & (F.col("over").isNull() | (F.col("over") < level)))
            cols = ["sample_id", "hap", "ref_chrom", "block_start", "block_seq", "ref_start", "ref_end", "event_type", "asm_start", "asm_end", "mapq", "asm_gap_size"]
            assert rows_of(here, *cols) == rows_of(M.sv_gaps(blocks, level), *cols), (run_rows, level)


def test_frontier_against_all_earlier_blocks():
    rng = random.Random(3)
    for _ in range(50):
        front, seen = Frontier(), []
        for i in range(40):
            quality, reach = rng.randrange(8), rng.randrange(12)
            for level in range(10):
                best = max((b for b in seen if b[0] >= level), key=lambda b: (b[1], -b[2]), default=None)
                got = [row for row, over, upto in front.before(9) if (over is None or over < level) and level <= upto]
                assert got == ([best[2]] if best else [])
            front.add(quality, reach, i)
            seen.append((quality, reach, i))


def test_lookup_gives_what_plain_blocks_give(spark):
    blocks, windows = two_samples(spark), asked(spark)
    for width, buckets in ((64, 3),):
        path = scratch_folder(spark, "lookup")
        M.build_lookup(blocks, path, width, buckets, run_rows=32)
        found = open_lookup(spark, path)
        assert rows_of(M.map_regions(windows, found), *HITS) == rows_of(M.map_regions(windows, blocks, bin_width=512), *HITS)
        plain = windows.drop("min_mapq")
        for level in (30,):
            assert rows_of(M.map_regions(plain, found, level), *HITS) == rows_of(M.map_regions(plain, blocks, level, bin_width=512), *HITS)
            cols = ["region_id", "status", "hap", "asm_chrom", "strand", "start", "end"]
            assert rows_of(M.translate(plain, found, level), *cols) == rows_of(M.translate(plain, blocks, level, bin_width=512), *cols)
        cols = ["region_id", "hap", "label", "ref_start", "gap_size"]
        assert rows_of(M.sv_annotations(plain, found), *cols) == rows_of(M.sv_annotations(plain, blocks), *cols)
        assert found.blocks.where("bin = first_bin").count() == blocks.count()
        found.forget()
        again = open_lookup(spark, path)  # from the files alone
        assert again.gaps.count() == found.gaps.count() > 0
        again.forget()


def test_lookup_of_nothing(spark):
    path = scratch_folder(spark, "lookup")
    M.build_lookup(spark.createDataFrame([], BLOCKS), path, 64, 2)
    assert M.map_regions(asked(spark), open_lookup(spark, path)).count() == 0


def test_windows_move_and_stored_rows_do_not(spark):
    """Joins with the lookup shuffle no stored table, read its chromosomes only, and no CIGAR text is in them; two folds in all."""
    path = scratch_folder(spark, "lookup")
    found = M.build_lookup(two_samples(spark), path, 64, 8)
    few = regions_df(spark, [("chr1", 10, 900)])
    spark.conf.set("spark.sql.optimizer.dynamicPartitionPruning.enabled", "false")  # its subqueries show the plan below them again
    try:
        plan = M.translate(few, found)._jdf.queryExecution()
        optimized, physical = plan.optimizedPlan().toString(), plan.executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.optimizer.dynamicPartitionPruning.enabled")
    assert optimized.count("aggregate(") == 2
    assert "cigar" not in physical
    large = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = M.gaps_in_windows(few, found)
        text = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", large)
    # Only windows are dealt: for the join and, shown again, for the pruning of folders by chromosome.
    assert text.count("Exchange") == text.count("REPARTITION_BY_NUM") > 0 and "SelectedBucketsCount" in text and "dynamicpruning" in text
    rows = found.blocks.where("ref_chrom = 'chr1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ref_chrom" in rows


def test_offsets_and_features_move_no_row(spark):
    df = spark.createDataFrame([(1, 5, "3S4M2X1D", 0, 4)], "k long, start long, cigar string, lo long, hi long")
    for out in (cigar_features(df, ["k"]), df.select(C.block_offsets(F.col("cigar"), F.col("lo"), F.col("hi")))):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_features_of_odd_cigars(spark):
    rows = [(1, 10, None), (2, 10, ""), (3, 10, "xx"), (4, None, "2S3M1I2X"), (5, 10, "4H3S1P2S5M0X2X1D3S2H"), (5, 10, "4H3S1P2S5M0X2X1D3S2H")]
    got = {r.k: r for r in cigar_features(spark.createDataFrame(rows, "k long, start long, cigar string")).collect()}
    assert all(got[k].indels == got[k].mismatches == got[k].soft_clips == [] for k in (1, 2, 3))
    assert [x.ref_pos for x in got[4].mismatches] == [None, None]
    assert [tuple(x) for x in got[5].soft_clips] == [(10, 3, True), (10, 2, False), (18, 3, False)]
    assert [tuple(x) for x in got[5].mismatches] == [(15, "X"), (16, "X")] and [tuple(x) for x in got[5].indels] == [(17, 1, "deletion")]


def brute_islands(rows, gap):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1] + gap:
            last = out[-1]
            last[2] += max(e - max(s, last[1]), 0)
            last[3] += s > last[1]
            last[1] = max(last[1], e)
        else:
            out.append([s, e, max(e - s, 0), 1])
    return [tuple(r) for r in out]


def test_islands_over_many_bins(spark):
    rng, rows = random.Random(7), []
    for key in range(12):
        for _ in range(rng.choice([1, 3, 40])):
            s = rng.randrange(-30, 600)
            rows.append((key, s, s + rng.choice([0, 1, 5, 20, 64, 300])))
        rows += [rows[-1]] * 20
    df = spark.createDataFrame(rows, "key long, start long, end long").union(spark.createDataFrame([(1, None, 5)], "key long, start long, end long"))
    for gap in (0, 3, 100):
        for width in (16, 64, 1 << 20):
            got = rows_of(I.islands(df, ["key"], max_gap=gap, bin_width=width), "key", "start", "end", "covered", "pieces")
            assert got == sorted((k, *r) for k in range(12) for r in brute_islands([(s, e) for key, s, e in rows if key == k], gap)), (gap, width)


def test_islands_plan_their_input_once(spark):
    plan = I.merge_intervals(blocks_df(spark, many_blocks(n=20)), ["hap"], "asm_start", "asm_end")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 3 and plan.count("Scan ExistingRDD") == 1


def test_gaps_do_not_hang_on_batches(spark):
    """Rows that come in many small batches give the gaps of one batch: the front is carried between them."""
    blocks = two_samples(spark)
    cols = ["sample_id", "hap", "ref_chrom", "over", "upto", "block_seq", "ref_start", "ref_end", "event_type"]
    whole = rows_of(M.quality_gaps(blocks, 64), *cols)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert rows_of(M.quality_gaps(blocks, 64), *cols) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lookup_has_as_many_buckets_as_shuffles(spark):
    """Fewer buckets than shuffle partitions would leave few, large tasks at size."""
    from checks import views

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    views._LOOKUPS.clear()
    try:
        assert views.lookup(spark, "/root/testdata/sf0.001").buckets == 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        views._LOOKUPS.clear()


def test_runs_are_reduced_without_python(spark):
    """Rows go through Python once, when runs are passed."""
    plan = M.quality_gaps(two_samples(spark), 64)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_stored_rows_stay_under_default_settings(spark):
    """Spark's default for co-partitioning leaves the blocks in their buckets too, and one join gives alignments and gaps."""
    found = M.build_lookup(two_samples(spark).where("length(cigar) <= 128"), scratch_folder(spark, "lookup"), 64, 8)
    name, large = "spark.sql.requireAllClusterKeysForCoPartition", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    old = spark.conf.get(name)
    spark.conf.set(name, "true")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        hits = M.map_regions(asked(spark), found)
        text = hits._jdf.queryExecution().executedPlan().toString()
        strict = rows_of(hits, *HITS)
    finally:
        spark.conf.set(name, old)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", large)
    assert text.count("Exchange") == text.count("REPARTITION_BY_NUM") == text.count("SortMergeJoin") == 1
    assert strict == rows_of(M.map_regions(asked(spark), found), *HITS) == rows_of(
        M.map_regions(asked(spark), two_samples(spark).where("length(cigar) <= 128"), bin_width=512), *HITS)


def test_short_cigars_are_stored_in_their_blocks(spark):
    """No entry is moved and stored apart for a CIGAR of one entry; over all the entries are the same."""
    blocks = two_samples(spark)
    found = M.build_lookup(blocks, scratch_folder(spark, "lookup"), 64, 4, run_rows=64)
    assert found.table("ops").join(found.table("blocks").select("block_no", "n_ops").distinct(), "block_no").where("n_ops <= 32").isEmpty()
    once = found.ops.dropDuplicates(["block_no", "entry_start"])
    whole = blocks.select(F.explode(C.cigar_index(F.col("cigar"), F.col("ref_end") - F.col("ref_start"))["entries"]).alias("e")).where("e.upto > e.at")
    assert rows_of(once, F.size("sizes"), "codes") == rows_of(whole, F.size("e.sizes"), "e.codes")


def test_stretches_hand_on_what_lies_before(spark):
    """A gap whose flanks lie many stretches apart, blocks without a base, a mapping quality or a place, and one over many stretches."""
    rows = [("chr1", 10, 60, "a", 0, 50, "+", 60, "50M"), ("chr1", 90_000, 90_050, "a", 60, 110, "+", 30, "50M"), ("chr1", 20, 50_000, "a", 9, 50_000, "-", 5, ""),
            ("chr1", 70_000, 70_000, "b", 5, 5, "+", 60, "3I"), ("chr1", 80_000, 80_010, "b", 5, 15, "+", None, "10M"), (None, 1, 5, "b", 5, 15, "+", 60, "10M"),
            ("chr1", None, 80_010, "b", 5, 15, "+", 60, "10M")]
    blocks = blocks_df(spark, [(*r[:1], r[1] or 0, *r[2:]) for r in rows]).withColumn("ref_start", F.when(F.col("block_seq") != 6, F.col("ref_start")))
    windows = regions_df(spark, [("chr1", 0, 100_000), ("chr1", 55, 70_001), ("chr1", 69_000, 90_010)])
    found = M.build_lookup(blocks, scratch_folder(spark, "lookup"), 1024, 4, run_rows=1024)
    for level in (0, 40):
        got = rows_of(M.map_regions(windows, found, level), *HITS)
        placed = blocks.where("ref_start is not null and ref_chrom is not null")  # the others take no part
        assert got == rows_of(M.map_regions(windows, placed, level, bin_width=4096), *HITS) and got


def test_window_hits_move_once(spark):
    """Merging a window's hits shuffles them once, and what joins or lists them moves nothing else but windows."""
    from strandweave.plans import subset as P

    found = M.build_lookup(two_samples(spark).where("length(cigar) <= 128"), scratch_folder(spark, "lookup"), 64, 8)
    few = spark.createDataFrame([(i, "chr1", 40 * i, 40 * i + 200, 200) for i in range(9)], "var_seq long, chrom string, pos long, end long, size long")
    large = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.optimizer.dynamicPartitionPruning.enabled", "false")  # its subqueries show windows again
    try:
        for df in (M.translate(asked(spark).withColumn("sample_id", F.lit("s")), found), P.compute_regions(few, found, "s", 50)):
            text = df._jdf.queryExecution().executedPlan().toString()
            assert 0 < text.count("Exchange") <= 3, text
    finally:
        spark.conf.unset("spark.sql.optimizer.dynamicPartitionPruning.enabled")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", large)


def test_rows_are_numbered_without_python(spark):
    from checks import views

    df = spark.range(1000, numPartitions=7).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("a"), "id").orderBy("a", "id")
    got = views.numbered(df)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.orderBy("ord").collect()] == [(*r, i) for i, r in enumerate(df.collect())]
