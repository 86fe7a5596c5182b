"""CIGARs of a whole batch as arrays of offsets, in one pass over their bytes.

The functions here take a column of CIGARs and work on all operations of an
Arrow batch at once. Nothing is exploded, regrouped or shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of the operations, and those that advance each side.
OPS = "MIDNSHPX="
REF_OPS = ("M", "D", "N", "X", "=")
ASM_OPS = ("M", "I", "S", "X", "=")
#: Operations in one entry of an index.
STEP = 64


def _table(letters) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in letters]] = True
    return out


_IS_OP, _ON_REF, _ON_ASM = _table(OPS), _table(REF_OPS), _table(ASM_OPS)


@dataclass
class Ops:
    """All operations of a batch in a row: ``first[i]`` to ``first[i + 1] - 1`` are those of row ``i``.

    ``ref`` and ``asm`` count the bases before each operation from the start of
    the batch, with one more entry for the end. In ``text``, the bytes of the
    batch, an operation stands at ``begins`` and ends before ``ends``.
    """

    first: np.ndarray
    op: np.ndarray
    size: np.ndarray
    ref: np.ndarray
    asm: np.ndarray
    text: np.ndarray
    begins: np.ndarray
    ends: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def parse(cigars: pa.Array) -> Ops:
    """Operations of each CIGAR; text that is no token is skipped, a null has none."""
    cigars = pc.fill_null(cigars.cast(pa.large_binary()), b"")
    at = np.frombuffer(cigars.buffers()[1], np.int64)[cigars.offset : cigars.offset + len(cigars) + 1]
    body = cigars.buffers()[2]
    data = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    at = at - at[0]
    digit = (data >= 48) & (data <= 57)
    opens = np.zeros(len(data) + 1, bool)
    opens[at[:-1]] = True
    after = np.concatenate([[False], digit[:-1]]) & ~opens[:-1] if len(data) else digit
    ends = np.flatnonzero(_IS_OP[data] & after)
    runs = np.flatnonzero(digit & ~after)
    begins = runs[np.searchsorted(runs, ends) - 1] if len(ends) else ends
    digits = ends - begins
    if digits.max(initial=0) > 18:
        raise ValueError("a CIGAR operation is longer than a long")
    size = np.zeros(len(ends), np.int64)
    for j in range(int(digits.max(initial=0))):
        more = digits > j
        size[more] = size[more] * 10 + data[begins[more] + j] - 48
    op = data[ends]
    total = lambda on: np.concatenate([[0], np.cumsum(np.where(on[op], size, 0))]).astype(np.int64)
    return Ops(np.searchsorted(ends, at).astype(np.int64), op, size, total(_ON_REF), total(_ON_ASM), data, begins, ends + 1)


def project(ops: Ops, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reference offsets ``[lo, hi)`` of each row's block as assembly offsets.

    Deletions clamp to the assembly position beside them; an insertion counts
    only when the interval straddles it. Past the last operation both are the
    row's assembly total. A row without operations keeps the offsets as they are.
    """
    first, end = ops.first[:-1], ops.first[1:]
    base, asm0 = ops.ref[first], ops.asm[first]
    total = ops.asm[end] - asm0
    closes = ops.ref[1:]

    def at(place, target):
        known = place < end
        i = np.where(known, place, 0)
        if not len(ops.op):
            return total
        inner = np.where(_ON_ASM[ops.op[i]], target - (ops.ref[i] - base), 0)
        return np.where(known, ops.asm[i] - asm0 + inner, total)

    start = np.maximum(np.searchsorted(closes, base + lo, "right"), first)
    stop = np.maximum(np.searchsorted(closes, base + hi, "left"), start)
    some = end > first
    return np.where(some, at(start, lo), lo), np.where(some, at(stop, hi), hi)


def _longs(values: pa.Array) -> np.ndarray:
    return pc.fill_null(values.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


def _offsets(cigar: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
    a, b = project(parse(cigar), _longs(lo), _longs(hi))
    return pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["lo", "hi"])


def _column(run, kind: str, *args: Column) -> Column:
    """Not deterministic by name only: that keeps the optimizer from running it again in every filter above it."""
    return F.arrow_udf(run, kind).asNondeterministic()(*args)


def block_offsets(cigar: Column, lo: Column, hi: Column) -> Column:
    """``struct<lo, hi>``: ``project`` of one interval per row, by binary search in the batch's offsets."""
    return _column(_offsets, "struct<lo:bigint,hi:bigint>", cigar, lo, hi)


_INDEX = (
    "struct<n_ops:bigint,whole_lo:bigint,whole_hi:bigint,asm_total:bigint,"
    "entries:array<struct<at:bigint,upto:bigint,asm:bigint,sizes:array<bigint>,codes:string>>>"
)


def _index(cigar: pa.Array, length: pa.Array) -> pa.Array:
    ops, n = parse(cigar), _longs(length)
    lo, hi = project(ops, np.zeros(len(n), np.int64), n)
    count = np.diff(ops.first)
    entries = -(-count // STEP)
    bounds = np.concatenate([[0], np.cumsum(entries)])
    row = np.repeat(np.arange(len(n)), entries)
    begin = ops.first[row] + (np.arange(bounds[-1]) - bounds[row]) * STEP
    end = np.minimum(begin + STEP, ops.first[row + 1])
    base = ops.first[row]
    cuts = pa.array(np.concatenate([begin, [len(ops.op)]]).astype(np.int32))
    codes = pa.StringArray.from_buffers(len(begin), cuts.buffers()[1], pa.py_buffer(ops.op.tobytes()))
    table = pa.StructArray.from_arrays(
        [pa.array(ops.ref[begin] - ops.ref[base]), pa.array(ops.ref[end] - ops.ref[base]), pa.array(ops.asm[begin] - ops.asm[base]),
         pa.ListArray.from_arrays(cuts, pa.array(ops.size)), codes],
        ["at", "upto", "asm", "sizes", "codes"])
    return pa.StructArray.from_arrays(
        [pa.array(count), pa.array(lo), pa.array(hi), pa.array(ops.asm[ops.first[1:]] - ops.asm[ops.first[:-1]]),
         pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), table)],
        ["n_ops", "whole_lo", "whole_hi", "asm_total", "entries"])


def short_index(cigar: pa.Array, length: pa.Array) -> dict[str, pa.Array]:
    """What ``cigar_index`` says of CIGARs that are one entry each, as columns: the entry's ``upto``, ``sizes`` and ``codes`` are the block's."""
    ops, n = parse(cigar), _longs(length)
    lo, hi = project(ops, np.zeros(len(n), np.int64), n)
    first, end = ops.first[:-1], ops.first[1:]
    cuts = pa.array(ops.first.astype(np.int32))
    codes = pa.StringArray.from_buffers(len(n), cuts.buffers()[1], pa.py_buffer(ops.op.tobytes()))
    return {"n_ops": pa.array(end - first), "whole_lo": pa.array(lo), "whole_hi": pa.array(hi), "asm_total": pa.array(ops.asm[end] - ops.asm[first]),
            "upto": pa.array(ops.ref[end] - ops.ref[first]), "sizes": pa.ListArray.from_arrays(cuts, pa.array(ops.size)), "codes": codes}


def cigar_index(cigar: Column, length: Column) -> Column:
    """What lookups in a block need: its number of operations, where its first ``length`` reference bases lie, and an entry per 64 operations.

    An entry has the reference and assembly bases before it (``at``, ``asm``),
    the reference bases up to its end (``upto``) and its operations.
    """
    return _column(_index, _INDEX, cigar, length)


_CELLS = "array<struct<first_bin:bigint,last_bin:bigint,at:bigint,asm:bigint,piece:string>>"


def _cells(cigar: pa.Array, length: pa.Array, width: pa.Array) -> pa.Array:
    ops, n = parse(cigar), _longs(length)
    w = int(_longs(width)[0]) if len(width) else 1
    first, end = ops.first[:-1], ops.first[1:]
    base = ops.ref[first]
    last = np.maximum(ops.ref[end] - base - 1, 0) // w
    upto = np.maximum(last, np.maximum(n - 1, 0) // w)
    # A cell opens at bin 0, where an operation begins or ends, and behind that; bins between are one operation's.
    row = ops.rows()
    which = np.flatnonzero(upto[row] > 0)
    row = row[which]
    low = (ops.ref[which] - base[row]) // w
    high = np.maximum(ops.ref[which + 1] - base[row] - 1, ops.ref[which] - base[row]) // w
    some = np.flatnonzero(end > first)
    row = np.concatenate([some, row, row, row, row])
    opens = np.concatenate([np.zeros(len(some), np.int64), low, low + 1, high, high + 1])
    row, opens = row[opens <= upto[row]], opens[opens <= upto[row]]
    order = np.lexsort((opens, row))
    row, opens = row[order], opens[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (opens[1:] != opens[:-1])
    row, opens = row[fresh], opens[fresh]
    bounds = np.searchsorted(row, np.arange(len(n) + 1))
    closes = upto[row]
    inner = np.flatnonzero(row[1:] == row[:-1]) if len(row) else row
    closes[inner] = opens[inner + 1] - 1
    reach = ops.ref[1:]
    begin = np.clip(np.searchsorted(reach, base[row] + opens * w, "right"), first[row], end[row] - 1)
    stop = np.minimum(np.searchsorted(reach, base[row] + (closes + 1) * w, "left") + 1, end[row])
    stop = np.where(closes >= last[row], end[row], np.maximum(stop, begin + 1))
    start, size = ops.begins[begin], ops.ends[stop - 1] - ops.begins[begin]
    cuts = np.concatenate([[0], np.cumsum(size)])
    body = ops.text[np.repeat(start - cuts[:-1], size) + np.arange(cuts[-1])]
    pieces = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes()))
    table = pa.StructArray.from_arrays(
        [pa.array(opens), pa.array(closes), pa.array(ops.ref[begin] - base[row]), pa.array(ops.asm[begin] - ops.asm[first[row]]),
         pieces.cast(pa.string())],
        ["first_bin", "last_bin", "at", "asm", "piece"])
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), table)


def cigar_cells(cigar: Column, length: Column, width: int) -> Column:
    """The CIGAR by bins of ``width`` reference bases: for ``first_bin`` to ``last_bin`` the ``piece`` that touches them.

    ``at`` and ``asm`` are the reference and assembly bases before the piece.
    Bins go as far as the operations and ``length`` do; those past the last
    operation have it as their piece. Bins inside one operation are one item. A
    row without operations has none.
    """
    return _column(_cells, _CELLS, cigar, length, F.lit(width).cast("bigint"))


_FEATURES = (
    "struct<indels:array<struct<ref_pos:bigint,length:int,kind:string>>,"
    "mismatches:array<struct<ref_pos:bigint,read_base:string>>,"
    "soft_clips:array<struct<ref_pos:bigint,length:int,is_leading:boolean>>>"
)


def _features(cigar: pa.Array, start: pa.Array) -> pa.Array:
    ops = parse(cigar)
    row = ops.rows()
    ref = ops.ref[:-1] - ops.ref[ops.first[row]]
    start = start.cast(pa.int64())

    def lists(which: np.ndarray, shift: np.ndarray | None, **fields) -> pa.Array:
        """One list per row of the operations ``which``, those of a row in their order."""
        of = row[which]
        place = ref[which] if shift is None else ref[which] + shift
        bounds = np.searchsorted(of, np.arange(len(ops.first))).astype(np.int32)
        pos = pc.add(start.take(pa.array(of)), pa.array(place))
        return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pos, *fields.values()], ["ref_pos", *fields]))

    letter = lambda c: ops.op == ord(c)
    indel = np.flatnonzero(letter("I") | letter("D"))
    kind = pa.array(np.where(ops.op[indel] == ord("I"), "insertion", "deletion"), pa.string())
    run = np.flatnonzero(letter("X"))
    each = np.repeat(run, ops.size[run])
    ends = np.cumsum(ops.size[run])
    inside = np.arange(len(each)) - np.repeat(ends - ops.size[run], ops.size[run])
    clip = np.flatnonzero(letter("S"))
    body = np.concatenate([[0], np.cumsum(~(letter("H") | letter("P")))])
    leading = body[clip] == body[ops.first[row[clip]]]
    length = lambda at: pa.array(ops.size[at]).cast(pa.int32())
    return pa.StructArray.from_arrays(
        [lists(indel, None, length=length(indel), kind=kind), lists(each, inside, read_base=pa.array(["X"] * len(each), pa.string())),
         lists(clip, None, length=length(clip), is_leading=pa.array(leading))],
        ["indels", "mismatches", "soft_clips"])


def features(cigar: Column, start: Column) -> Column:
    """``struct<indels, mismatches, soft_clips>`` with 1-based reference positions."""
    return _column(_features, _FEATURES, cigar, start)
