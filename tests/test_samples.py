"""Many samples in one job, and long sequences in parts."""

import random

import pytest
from pyspark.sql import functions as F

from strandweave.operators.sequences import chunk_sequences, slice_parts, slice_sequences
from strandweave.operators.variants import select_variants
from strandweave.plans import subset as P
from strandweave.sources import sequences, writers
from tests.helpers import blocks_df, rows_of, shuffled_bytes

SAM = "name\t{flag}\tchr1\t{pos}\t60\t5M\t{mate}\t7\t0\t*\t*\tXX:Z:a\tSA:Z:chr1,{sa},+,5M,1,0;"


def test_variants_are_chosen_for_each_sample(spark):
    rng = random.Random(1)
    rows = [(s, i, f"chr{rng.randrange(6)}", rng.randrange(500), rng.randrange(30), "0|1") for s, n in (("a", 40), ("b", 3), ("c", 25)) for i in range(n)]
    df = spark.createDataFrame(rows, "sample_id string, var_seq long, chrom string, pos long, size long, genotype string")
    cols = ["sample_id", "var_seq", "pick_ord"]
    for k in (1, 4, 30):
        apart = [r for s in "abc" for r in rows_of(select_variants(df.where(F.col("sample_id") == s), k), *cols)]
        assert rows_of(select_variants(df, k, ["sample_id"]), *cols) == sorted(apart)


def test_regions_of_two_samples_stay_apart(spark):
    blocks = blocks_df(spark, [("chr1", 0, 500, "x", 1000, 1500, "+", 60)], "a").union(blocks_df(spark, [("chr1", 0, 500, "y", 0, 500, "-", 60)], "b"))
    variants = spark.createDataFrame([(s, 1, "chr1", 100, 20, "0|1", 121) for s in "ab"], "sample_id string, var_seq long, chrom string, pos long, size long, genotype string, end long")
    got = {r.sample_id: r.hap1_regions for r in P.compute_regions(variants, blocks, padding=10).collect()}
    assert got == {"a": ["x:1090-1131"], "b": ["y:369-410"]}
    assert P.variant_manifest(variants, blocks, k=1, padding=10).count() == 2


def test_reads_of_two_samples_stay_apart(spark):
    """Same names, flags and places in two samples; regions of one are no regions of the other."""
    rows = [(s, "chr1", 1000, 1004, "name", 0, seq, SAM.format(flag=0, pos=1000, mate="chr1:900-1100", sa=1002)) for s, seq in (("a", 5), ("b", 5))]
    reads = spark.createDataFrame(rows, "sample_id string, chrom string, start long, end long, name string, flags int, read_seq long, line string")
    spans = spark.createDataFrame([("a", 0, "chr1", 900, 1100), ("b", 0, "chr1", 990, 1200)], "sample_id string, region_ord long, chrom string, start long, end long")
    got = {r.sample_id: r.line.split("\t") for r in P.subset_reads(spans, reads).collect()}
    assert got["a"][2:4] == ["chr1:900-1100", "101"] and got["a"][6:8] == ["chr1:900-1100", "7"] and got["a"][12].startswith("SA:Z:chr1:900-1100,103,")
    assert got["b"][2:4] == ["chr1:990-1200", "11"] and got["b"][6:8] == ["*", "0"] and got["b"][12].startswith("SA:Z:chr1:990-1200,13,")


def test_a_sam_line_moves_once(spark):
    reads = spark.createDataFrame([], "chrom string, start long, end long, name string, flags int, read_seq long, line string")
    spans = spark.createDataFrame([], "region_ord long, chrom string, start long, end long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = P.subset_reads(spans, reads)._jdf.queryExecution().executedPlan()
        text = plan.toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved, lines = 0, text.split("\n")
    for i, line in enumerate(lines):
        if "Exchange hash" in line and "line#" in lines[i + 1]:
            moved += "AS mate" not in lines[i + 1] and "AS tags" not in lines[i + 1]
    assert moved <= 1


@pytest.mark.parametrize("width, part", [(10, 40), (60, 60)])
def test_long_records_are_written_in_parts(spark, tmp_path, width, part):
    rng = random.Random(2)
    seqs = {f"c{i}": "".join(rng.choice("ACGT") for _ in range(n)) for i, n in enumerate((1, 59, 60, 61, 977))}
    chunks = spark.createDataFrame([("g", name, k, s[k * 25 : k * 25 + 25]) for name, s in seqs.items() for k in range(-(-len(s) // 25))], "genome string, name string, chunk int, bases string")
    asked = spark.createDataFrame([(i, "g", n, start, 2000) for i, n in enumerate(seqs) for start in (1, 27)] + [(9, "g", "zz", 1, 5)], "ord long, genome string, chrom string, start long, end long")
    parts = P.subset_parts(asked, chunks, 25, part)
    assert parts.agg(F.max(F.length("bases"))).first()[0] <= part
    writers.write_fasta_parts(parts, str(tmp_path / "f"), width)
    assert max(len(r.value) for r in spark.read.text(str(tmp_path / "f")).where("not startswith(value, '>')").collect()) == width
    got = rows_of(sequences.read_fasta(spark, str(tmp_path / "f")), "name", "seq")
    assert got == sorted((f"{n}:{start}-2000", s[start - 1 :]) for n, s in seqs.items() for start in (1, 27) if s[start - 1 :])


def test_only_parts_over_chunk_ends_are_moved(spark):
    """Parts that lie in one chunk leave where they are cut; the rest is put together."""
    rng = random.Random(2)
    seqs = {f"c{i}": "".join(rng.choices("ACGT", k=rng.randint(0, 4000))) for i in range(60)}
    chunks = chunk_sequences(spark.createDataFrame([("g", n, s) for n, s in seqs.items()], "genome string, name string, seq string"), 700)
    asked = [(i, "g", n, rng.randint(1, 90), rng.randint(300, 5000)) for i, n in enumerate(seqs)]
    spans = spark.createDataFrame(asked, "region_id long, genome string, name string, start long, end long")
    got = slice_parts(spans, F.broadcast(chunks), size=700, part=120)
    expect = []
    for i, _, n, start, end in asked:
        letters = seqs[n][start - 1 : end]
        expect += [(i, p, letters[p * 120 : p * 120 + 120]) for p in range(-(-len(letters) // 120))]
    assert rows_of(got, "region_id", "part_no", "bases") == expect
    moved = shuffled_bytes(got)
    assert moved < 0.45 * sum(len(b) for _, _, b in expect), moved / sum(len(b) for _, _, b in expect)


def test_spans_far_past_the_end_have_no_rows_there(spark):
    """What is moved follows the letters that are there, not those that are asked for."""
    chunks = chunk_sequences(spark.createDataFrame([("g", f"n{i}", "ACGTN" * 5) for i in range(20)], "genome string, name string, seq string"), 10)
    spans = spark.createDataFrame([(i, "g", f"n{i}", 4, 3_000_000) for i in range(21)] + [(30, "g", "n1", 26, 99)], "region_id long, genome string, name string, start long, end long")
    whole = ("ACGTN" * 5)[3:]
    got = slice_sequences(spans, chunks, size=10)
    assert rows_of(got, "region_id", "bases") == [(i, whole if i < 20 else None) for i in range(21)] + [(30, "")]
    assert shuffled_bytes(got) < 100_000
    parts = slice_parts(spans, chunks, size=10, part=7)
    assert rows_of(parts, "region_id", "part_no", "bases") == [(i, j, whole[7 * j : 7 * j + 7]) for i in range(20) for j in range(4)]
    assert shuffled_bytes(parts) < 100_000
