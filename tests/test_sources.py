"""Files: the text forms, their oddities, and writers read back."""

import gzip
import json

from helpers import blocks_df, rows_of, shuffled_bytes
from pyspark.sql import functions as F

from strandweave.plans.mapping import build_mapping
from strandweave.plans.subset import subset_header, subset_reads
from strandweave.sources import alignments, paf, regions, samples, sequences, writers
from strandweave.sources.lines import read_lines, with_line_order
from strandweave.sources.paf import tag_value

PAF = "c1\t900\t0\t100\t+\tchr1\t5000\t{s}\t{e}\t95\t100\t60"


def test_paf_order_over_files(spark, tmp_path):
    a, b = tmp_path / "z.paf.gz", tmp_path / "a.paf"
    with gzip.open(a, "wt") as fh:
        fh.write("# note\n\n" + PAF.format(s=10, e=20) + "\tcg:Z:10M\n" + PAF.format(s=10, e=30) + "\tcg:Z:1M\tcg:Z:a:b\n")
    b.write_text(PAF.format(s=10, e=40) + "\ttp:A:S\nshort\tline\n")
    got = paf.read_paf(spark, [str(a), str(b)], "s", "hap1").orderBy("block_seq")
    assert rows_of(got, "ref_end", "cigar", "tp", order=True) == [(20, "10M", ""), (30, "a:b", ""), (40, "", "S")]


def test_build_then_read_json(spark, tmp_path):
    src = tmp_path / "x.paf"
    src.write_text("\n".join([PAF.format(s=50, e=60), PAF.format(s=10, e=20), PAF.replace("chr1", "chr2").format(s=1, e=2)]))
    stored = build_mapping(spark, [str(src)], str(tmp_path / "out"), "s", "hap1")
    assert rows_of(stored, "ref_chrom", "ref_start") == [("chr1", 10), ("chr1", 50), ("chr2", 1)]
    writers.write_mapping_json(stored, str(tmp_path / "json"))
    back = paf.read_mapping_json(spark, str(tmp_path / "json"))
    assert rows_of(back, "ref_chrom", "ref_start", "cigar") == [("chr1", 10, ""), ("chr1", 50, ""), ("chr2", 1, "")]
    doc = {"chr9": [{"rs": 5, "re": 9, "ac": "q", "as": 0, "ae": 4, "st": "-", "mq": 7, "cg": "4M"}]}
    with gzip.open(tmp_path / "one.json.gz", "wt") as fh:
        json.dump(doc, fh, indent=1)
    one = paf.read_mapping_json(spark, str(tmp_path / "one.json.gz"))
    assert rows_of(one, "ref_chrom", "ref_end", "asm_chrom", "strand", "mapq", "cigar") == [("chr9", 9, "q", "-", 7, "4M")]


def test_vcf_deletions(spark, tmp_path):
    sizes = [(5000, "0|1"), (3000, "1|1"), (2000, "1|0"), (1500, "0|0"), (500, "0|1"), (4000, "0/1"), (8000, "1/1")]
    lines = ["##x", "#CHROM"] + [f"chr{i}\t{100 * i}\t.\t{'A' * (n + 1)}\tA\t.\t.\t.\tGT\t{gt}" for i, (n, gt) in enumerate(sizes)]
    path = tmp_path / "v.vcf"
    path.write_text("\n".join(lines))
    got = regions.read_vcf_deletions(spark, str(path)).collect()
    assert [r["size"] for r in got] == [8000, 5000, 4000, 3000, 2000]
    assert got[0]["end"] == got[0]["pos"] + 8001
    assert regions.read_vcf_deletions(spark, str(path), 100).count() == 6


def test_manifest_and_unknown_files(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"description": "d", "variants": [
        {"chrom": "chr1", "pos": 10, "size": 1500, "genotype": "0|1", "ref_region": "chr1:5-2000", "hap1_regions": ["c:1-2"]},
        {"chrom": "chr2", "size": 7, "ref_region": "chr2:30-90"},
    ]}, indent=2))
    got = rows_of(regions.read_regions(spark, str(path)), "label", "ref_region", "fasta_region")
    assert got == [
        ("chr1:10-1510 (1.5 kb, 0|1)", "chr1:10-1510", "chr1:5-2000"),
        ("chr2:30-90 (7 bp, ?)", "chr2:30-90", "chr2:30-90"),
    ]
    for missing in (None, "", str(tmp_path / "none.json"), str(path) + ".txt"):
        assert regions.read_regions(spark, missing).count() == 0


def test_fasta_fai_and_sheet(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">chr1 first\nacgt\nNN\n>chr2\nTT\n")
    assert rows_of(sequences.read_fasta(spark, str(tmp_path / "x.fa")), "name", "seq") == [("chr1", "ACGTNN"), ("chr2", "TT")]
    (tmp_path / "y.fa").write_text("\n>c1 gene A->B\nACG\nTAC\r\nGT\n>empty\n>c2\n\nac gt\n")
    path = str(tmp_path / "y.fa")
    assert rows_of(sequences.read_fasta(spark, path), "name", "seq") == [("c1", "ACGTACGT"), ("c2", "ACGT"), ("empty", "")]
    for width in (1 << 20, 4):
        parts = sequences.read_fasta_chunks(spark, path, size=3, bin_width=width)
        assert rows_of(parts, "name", "chunk", "bases") == [
            ("c1", 0, "ACG"), ("c1", 1, "TAC"), ("c1", 2, "GT"), ("c2", 0, "ACG"), ("c2", 1, "T"), ("empty", 0, ""),
        ]
    (tmp_path / "x.fai").write_text("b\t5\t1\t2\t3\na\t9\t1\t2\t3\n")
    fai = sequences.read_fai(spark, str(tmp_path / "x.fai")).orderBy("contig_ord")
    assert rows_of(fai, "name", "length", order=True) == [("b", 5), ("a", 9)]
    (tmp_path / "s.tsv").write_text("\n#sample_id\treads_bam\textra\n# note\nA\tx.cram\nB\ty.bam\tz\n")
    sheet = samples.read_sample_sheet(spark, str(tmp_path / "s.tsv"))
    assert rows_of(sheet, "sample_id", "reads_bam", "reads_cram", "extra") == [("A", "", "x.cram", ""), ("B", "y.bam", "", "z")]


def test_lookup_json_is_read_item_by_item(spark, tmp_path):
    """White space, empty lists, escapes, files without items, and more bytes than a split."""
    item = lambda i, cg="5M": {"rs": i, "re": i + 5, "ac": f'c"{i}\\', "as": i, "ae": i + 5, "st": "+", "mq": 60, "cg": cg}
    docs = [
        {}, {"chr0": []}, {"chr1": [item(1), item(2)], "none": [], 'odd "name" [x]: é\\': [item(3)], "end": []},
        {"a": [item(i, "1M2D" * 50) for i in range(2000)], "b": [item(7)]}, {"chr1": [{k: v for k, v in item(9).items() if k != "cg"}]},
    ]
    (tmp_path / "json").mkdir()
    for i, doc in enumerate(docs):
        text = json.dumps(doc, indent=2 if i == 2 else None, ensure_ascii=i != 2, separators=(",", ":") if i == 3 else None)
        (tmp_path / "json" / f"{i}.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = paf.read_mapping_json(spark, str(tmp_path / "json"))
        got = [(r.ref_chrom, r.ref_start, r.asm_chrom, r.cigar) for r in found.orderBy("block_seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(chrom, b["rs"], b["ac"], b.get("cg", "")) for doc in docs for chrom, blocks in doc.items() for b in blocks]


def _sam(name, flag, pos, mate="*", mate_pos=0, sa=None):
    tags = [f"SA:Z:{sa}"] if sa else []
    return "\t".join([name, str(flag), "chr1", str(pos), "60", "50M", mate, str(mate_pos), "0", "*", "*", "AS:i:9", *tags])


def test_subset_of_reads(spark, tmp_path):
    path = tmp_path / "r.sam"
    path.write_text("\n".join([
        "@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:9999", "@RG\tID:g",
        _sam("r1", 0, 1200, "=", 1300, "chr1,1500,+,50M,60,0;chr9,5,+,50M,60,0;"),
        _sam("r2", 0, 1900, "chr7", 55, "chr8,1,+,5M,1,0;"), _sam("r3", 4, 1500), _sam("r4", 0, 990, "chr1", 1990),
        _sam("r5", 0, 5000),
    ]))
    reads = alignments.read_sam(spark, str(path))
    assert reads.count() == 4
    spans = spark.createDataFrame([(0, "chr1", 1000, 2000), (1, "chr1", 1800, 2500)], "region_ord long, chrom string, start long, end long")
    got = {r["line"].split("\t")[0]: r["line"].split("\t") for r in subset_reads(spans, reads).collect()}
    name = "chr1:1000-2000"
    assert set(got) == {"r1", "r2", "r4"}
    assert got["r1"][2:4] == [name, "201"] and got["r1"][6:8] == ["=", "301"]
    assert got["r1"][12] == f"SA:Z:{name},501,+,50M,60,0;"
    assert got["r2"][6:8] == ["*", "0"] and got["r2"][12] == "SA:Z:*"
    assert got["r4"][3] == "1" and got["r4"][6:8] == [name, "991"]
    head = [r["line"] for r in subset_header(spark, str(path), spans).collect()]
    assert head == ["@HD\tVN:1.6", "@SQ\tSN:chr1:1000-2000\tLN:1001", "@SQ\tSN:chr1:1800-2500\tLN:701", "@RG\tID:g"]


def test_hits_file_has_its_header(spark, tmp_path):
    from helpers import regions_df

    from strandweave.plans.mapping import map_regions

    blocks = blocks_df(spark, [("chr1", 0, 100, "c", 0, 100, "+", 60), ("chr1", 300, 400, "c", 100, 200, "+", 60)])
    writers.write_hits_tsv(map_regions(regions_df(spark, [("chr1", 50, 350)]), blocks), str(tmp_path / "t"))
    back = spark.read.csv(str(tmp_path / "t"), sep="\t", header=True)
    assert back.columns == writers.HIT_COLUMNS
    assert rows_of(back, "event_type", "ref_start", "ref_end") == [
        ("alignment", "300", "350"), ("alignment", "50", "100"), ("deletion", "100", "300"),
    ]


def test_lookup_tables_of_blocks_with_one_start(spark, tmp_path):
    """Which of two blocks of one start comes first is told by their numbers, not by where the table has them."""
    import duckdb

    import __spark_entry__ as entry

    rows = [(1, 111, 25, 2, 1.0, "N", "F"), (1, 0, 25, 1, 1.0, "N", "F"), (0, 0, 25, 1, 1.0, "N", "F"), (0, 0, 25, 3, 1.0, "N", "O")]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = entry.queries()["q1_lookup_tables"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    rel = con.sql(entry.oracle_sql()["q1_lookup_tables"])
    assert sorted(tuple(r) for r in df.select(*rel.columns).collect()) == sorted(rel.fetchall())


def test_lines_are_numbered_where_they_are_read(spark, tmp_path):
    """No line is moved to learn its file's number, and its path is not rewritten."""
    for name in ("a", "b"):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(50)))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        paths = [str(tmp_path / "b"), f"file://{tmp_path}/a"]
        rows = with_line_order(read_lines(spark, paths), paths, "n")
        assert [r.value for r in rows.orderBy("n").collect()] == [f"{name}{i}" for name in "ba" for i in range(50)]
        assert shuffled_bytes(rows) == 0
        assert "regexp_replace" not in rows._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_tag_values(spark):
    tags = [["cg:Z:1M", "cg", "cg:Z", "cgx:Z:2"], ["cg::x:y"], ["cg:Z:1", "cg:Z:"], ["xcg:Z:1"], []]
    df = spark.createDataFrame([(i, ["-"] * 12 + t) for i, t in enumerate(tags)], "i int, f array<string>")
    assert [r.v for r in df.orderBy("i").select(tag_value(F.col("f"), "cg").alias("v")).collect()] == ["1M", "x:y", "", "", ""]


def test_blocks_are_stored_after_one_reading(spark, tmp_path):
    """Rows are dealt without a look at all of them first; each file is sorted by start."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    blocks = blocks_df(spark, [("chr1", (i * 7919) % 4_000_000, 4_000_100, "a", 0, 9, "+", 60, "9M") for i in range(500)])
    writers.write_blocks(blocks.mapInArrow(count, blocks.schema), str(tmp_path / "b"))
    assert seen.value == 500
    stored = paf.read_blocks(spark, str(tmp_path / "b"))
    assert rows_of(stored, *blocks.columns) == rows_of(blocks, *blocks.columns)
    files = [[r.ref_start for r in spark.read.parquet(f).collect()] for f in stored.inputFiles()]
    assert files and all(f == sorted(f) for f in files)
