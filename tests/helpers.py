"""Small tables for the tests."""

import random

BLOCKS = (
    "sample_id string, hap string, block_seq long, ref_chrom string, ref_start long, ref_end long, "
    "asm_chrom string, asm_start long, asm_end long, strand string, mapq int, matches long, "
    "block_len long, cigar string, tp string"
)
REGIONS = "region_id long, sample_id string, chrom string, start long, end long"


def blocks_df(spark, rows, sample="s", hap="hap1"):
    """rows: (chrom, rs, re, contig, as, ae, strand, mapq[, cigar]) in input order."""
    full = []
    for i, r in enumerate(rows):
        chrom, rs, re, ac, a, b, st, mq = r[:8]
        full.append((sample, hap, i, chrom, rs, re, ac, a, b, st, mq, re - rs, re - rs, r[8] if len(r) > 8 else "", "P"))
    return spark.createDataFrame(full, BLOCKS)


def regions_df(spark, rows, sample="s"):
    return spark.createDataFrame([(i, sample, c, s, e) for i, (c, s, e) in enumerate(rows)], REGIONS)


def rows_of(df, *cols, order=None):
    out = [tuple(r) for r in df.select(*cols).collect()]
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t)) if order is None else out


def expand_cigar(cigar):
    """Per reference base its assembly offset, and per boundary the offset before it."""
    import re

    ref_to_asm, asm = [], 0
    for n, op in re.findall(r"(\d+)([MIDNSHPX=])", cigar):
        n = int(n)
        if op in "M=X":
            for _ in range(n):
                ref_to_asm.append((asm, asm + 1))
                asm += 1
        elif op in "DN":
            ref_to_asm.extend([(asm, asm)] * n)
        elif op in "IS":
            asm += n
    return ref_to_asm, asm


def random_cigar(rng: random.Random, n_ops: int) -> str:
    return "".join(f"{rng.randint(1, 9)}{rng.choice('MIDNS=XHP')}" for _ in range(n_ops))


def shuffled_bytes(df) -> int:
    """Bytes written to shuffles while all rows of ``df`` are made."""
    sc = df.sparkSession.sparkContext
    store = sc._jsc.sc().statusStore()

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        none = sc._gateway.new_array(sc._jvm.double, 0)
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before
