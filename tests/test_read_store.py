import random

from strandweave.plans.reads import reads_in_regions
from strandweave.sources import read_store
from tests.helpers import rows_of

COLUMNS = ["read_seq", "sample_id", "track", "chrom", "start", "end"]


def reads(spark):
    rng, rows = random.Random(1), []
    for i in range(400):
        start = rng.randrange(1, 2000)
        rows.append((i, rng.choice(["", "a", "b=c/d"]), rng.choice(["", "ref", "hap1"]), rng.choice(["1", "02"]), start, start + rng.choice([0, 5, 63, 64, 900])))
    return spark.createDataFrame(rows, "read_seq long, sample_id string, track string, chrom string, start long, end long"), rows


def test_windows_against_a_plain_scan(spark, tmp_path):
    df, rows = reads(spark)
    path = str(tmp_path / "store")
    read_store.write_reads(df, path, 64)
    assert rows_of(read_store.open_reads(spark, path).where("bin = first_bin"), *COLUMNS) == sorted(rows)
    for chrom, start, end, samples, tracks in (("1", 1, 64, None, None), ("1", 65, 65, ["a"], None), ("02", 500, 1500, ["", "b=c/d"], ["", "ref"]), ("x", 1, 9, None, None)):
        got = rows_of(read_store.read_window(spark, path, chrom, start, end, samples, tracks, 64), *COLUMNS)
        assert got == sorted(r for r in rows if r[3] == chrom and r[4] <= end and r[5] >= start
                             and (samples is None or r[1] in samples) and (tracks is None or r[2] in tracks))


def test_many_regions_and_what_is_read(spark, tmp_path):
    df, _ = reads(spark)
    path = str(tmp_path / "store")
    read_store.write_reads(df, path, 64)
    rng = random.Random(2)
    asked = [(i, rng.choice(["", "a", "b=c/d", "z"]), rng.choice(["1", "02"]), s := rng.randrange(1, 2500), s + rng.choice([-1, 0, 63, 700])) for i in range(60)]
    regions = spark.createDataFrame(asked, "region_id long, sample_id string, chrom string, start long, end long")
    cols = ["region_id", "read_seq", "track"]
    found = read_store.reads_of_regions(regions, read_store.open_reads(spark, path), 64)
    assert rows_of(found, *cols) == rows_of(reads_in_regions(regions, df, 64), *cols)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    one = read_store.read_window(spark, path, "1", 100, 300, ["a"], ["ref"], 64)._jdf.queryExecution().executedPlan().toString()
    assert "chrom_folder" in one.split("PartitionFilters")[1].split("]")[0] and "sample_folder" in one.split("PartitionFilters")[1].split("]")[0] and "GreaterThanOrEqual(bin,1)" in one
