"""CIGAR strings as Column expressions. No row leaves its task here.

``block_offsets``, ``cigar_cells``, ``cigar_index`` and ``features`` work on a batch of CIGARs at
once; they come from ``cigar_arrays``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandweave.functions.cigar_arrays import ASM_OPS, REF_OPS, block_offsets, cigar_cells, cigar_index, features  # noqa: F401

# Fixed value: one CIGAR token.
CIGAR_TOKEN = r"(\d+[MIDNSHPX=])"


def consumes_ref(op: Column) -> Column:
    return op.isin(*REF_OPS)


def consumes_asm(op: Column) -> Column:
    return op.isin(*ASM_OPS)


def cigar_ops(cigar: Column) -> Column:
    """``array<struct<len, op>>``; text that is no token is skipped."""
    tokens = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(CIGAR_TOKEN), F.lit(1))
    return F.transform(
        tokens,
        lambda t: F.struct(
            F.substring(t, F.lit(1), F.length(t) - 1).cast("bigint").alias("len"),
            F.right(t, F.lit(1)).alias("op"),
        ),
    )


def cigar_totals(cigar: Column) -> Column:
    """``struct<ref_len, asm_len>``: bases each side consumes."""
    zero = F.lit(0).cast("bigint")
    return F.aggregate(
        cigar_ops(cigar),
        F.struct(zero.alias("ref_len"), zero.alias("asm_len")),
        lambda acc, x: F.struct(
            (acc["ref_len"] + F.when(consumes_ref(x["op"]), x["len"]).otherwise(zero)).alias("ref_len"),
            (acc["asm_len"] + F.when(consumes_asm(x["op"]), x["len"]).otherwise(zero)).alias("asm_len"),
        ),
    )


def alignment_end(start: Column, cigar: Column) -> Column:
    """Last reference base covered (1-based inclusive); the start when nothing is."""
    span = cigar_totals(cigar)["ref_len"]
    return F.when(span > 0, start + span - 1).otherwise(start)


def orient(lo: Column, hi: Column, strand: Column, asm_start: Column, asm_end: Column) -> Column:
    """Block-relative assembly offsets to absolute coordinates."""
    plus = strand == "+"
    return F.struct(
        F.when(plus, asm_start + lo).otherwise(asm_end - hi).alias("start"),
        F.when(plus, asm_start + hi).otherwise(asm_end - lo).alias("end"),
    )


def entry_offset(sizes: Column, codes: Column, ref: Column, asm: Column, target: Column, past: bool) -> Column:
    """Assembly offset of the reference offset ``target`` inside one index entry, which holds at most 64 operations.

    ``ref`` and ``asm`` are the bases before the entry. The operation meant is
    the first that reaches ``target``, or with ``past`` goes beyond it.
    """
    none = F.lit(None).cast("bigint")

    def step(acc: Column, x: Column) -> Column:
        op = F.substring(codes, x["at"] + 1, F.lit(1))
        on_ref, on_asm = consumes_ref(op), consumes_asm(op)
        reach = acc["ref"] + x["size"]
        hit = on_ref & ((reach > target) if past else (reach >= target))
        inner = acc["asm"] + F.when(on_asm, target - acc["ref"]).otherwise(F.lit(0))
        return F.struct(
            F.when(on_ref, reach).otherwise(acc["ref"]).alias("ref"),
            F.when(on_asm, acc["asm"] + x["size"]).otherwise(acc["asm"]).alias("asm"),
            F.coalesce(acc["out"], F.when(hit, inner)).alias("out"),
        )

    items = F.transform(sizes, lambda size, i: F.struct(size.alias("size"), i.alias("at")))
    begin = F.struct(ref.cast("bigint").alias("ref"), asm.cast("bigint").alias("asm"), none.alias("out"))
    return F.aggregate(items, begin, step, lambda acc: acc["out"])
