"""Region strings, sizes, windows and padding as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the region text forms.
FIRST_COLON = r"^([^:]*):([^-]*)-(.*)$"
LAST_COLON = r"^(.+):(\d+)-(\d+)$"


def _region(chrom: Column, start: Column, end: Column, valid: Column) -> Column:
    keep = lambda c: F.when(valid, c)
    return F.struct(
        keep(chrom).alias("chrom"),
        keep(start).alias("start"),
        keep(end).alias("end"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def parse_region(text: Column) -> Column:
    """``chrom:start-end`` split at the first colon; bad text gives ``valid = false``."""
    start = F.trim(F.regexp_extract(text, FIRST_COLON, 2)).try_cast("bigint")
    end = F.trim(F.regexp_extract(text, FIRST_COLON, 3)).try_cast("bigint")
    ok = text.rlike(FIRST_COLON) & start.isNotNull() & end.isNotNull()
    return _region(F.regexp_extract(text, FIRST_COLON, 1), start, end, ok)


def parse_region_greedy(text: Column) -> Column:
    """``chrom:start-end`` split at the last colon, for contig names holding colons."""
    start = F.regexp_extract(text, LAST_COLON, 2).try_cast("bigint")
    end = F.regexp_extract(text, LAST_COLON, 3).try_cast("bigint")
    return _region(F.regexp_extract(text, LAST_COLON, 1), start, end, text.rlike(LAST_COLON))


def parse_region_viewer(text: Column) -> Column:
    """Thousands separators allowed; 1-based, so start >= 1 and end >= start."""
    bare = lambda g: F.replace(
        F.regexp_extract(text, FIRST_COLON, g), F.lit(","), F.lit("")
    ).try_cast("bigint")
    start, end = bare(2), bare(3)
    ok = text.rlike(FIRST_COLON) & (start >= 1) & (end >= start)
    return _region(F.regexp_extract(text, FIRST_COLON, 1), start, end, ok)


def format_region(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def _one_decimal(bp: Column, unit: int) -> Column:
    """``bp / unit`` with one decimal, rounded as printf rounds the binary double.

    Only values halfway between two tenths need care: there the double nearest
    to ``bp / unit`` may lie just above, just below or exactly on the tie.
    Splitting the double in two halves makes ``double * unit - bp`` exact, and
    its sign tells which.
    """
    tenth = unit // 10
    whole = F.floor(bp / F.lit(tenth))
    rest = bp - whole * tenth
    value = bp.cast("double") / F.lit(float(unit))
    scaled = value * F.lit(134217729.0)
    high = scaled - (scaled - value)
    low = value - high
    above = (high * F.lit(float(unit)) - bp.cast("double")) + low * F.lit(float(unit))
    tie_up = F.when(above != 0, above > 0).otherwise(whole % 2 == 1)
    up = F.when(rest * 2 == tenth, tie_up).otherwise(rest * 2 > tenth)
    tenths = whole + F.when(up, 1).otherwise(0)
    return F.concat(
        F.floor(tenths / F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string")
    )


def format_size(bp: Column) -> Column:
    """``950 bp``, ``1.5 kb`` or ``2.0 Mb``."""
    return (
        F.when(bp >= 1_000_000, F.concat(_one_decimal(bp, 1_000_000), F.lit(" Mb")))
        .when(bp >= 1000, F.concat(_one_decimal(bp, 1000), F.lit(" kb")))
        .otherwise(F.concat(bp.cast("string"), F.lit(" bp")))
    )


def region_label(chrom: Column, start: Column, end: Column, size: Column, gt: Column) -> Column:
    """``chrom:start-end (size[, genotype])``; an empty genotype is left out."""
    return F.concat(
        format_region(chrom, start, end),
        F.lit(" ("),
        format_size(size),
        F.when(F.coalesce(gt, F.lit("")) != "", F.concat(F.lit(", "), gt)).otherwise(F.lit("")),
        F.lit(")"),
    )


def window_status(start: Column, end: Column, limit: int | None = None) -> Column:
    """``ok``, ``invalid``, ``empty`` or, over a limit the caller sets, ``too_large``."""
    status = F.when((start < 0) | (end < 0) | (end < start), "invalid").when(end == start, "empty")
    return (status if limit is None else status.when(end - start > limit, "too_large")).otherwise("ok")


def clamp(value: Column, default: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """``default`` where ``value`` is missing; kept within the bounds that are given."""
    value = F.coalesce(value, default)
    value = value if high is None else F.least(value, high)
    return value if low is None else F.greatest(low, value)


def clamp_k(k: Column, low: int | None = None, high: int | None = None) -> Column:
    """K-mer length; 31 when missing."""
    return clamp(k, F.lit(31), *(None if x is None else F.lit(x) for x in (low, high)))


def clamp_buffer(buffer: Column, low: float | None = None, high: float | None = None) -> Column:
    """Buffer multiplier; 1 when missing."""
    return clamp(buffer, F.lit(1.0), *(None if x is None else F.lit(float(x)) for x in (low, high)))


def buffered_window(start: Column, end: Column, buffer: Column, limit: int | None = None) -> Column:
    """Window padded by ``buffer`` spans each side, from 0 on: ``start, end, trimmed``.

    With a ``limit`` the window is cut to it on both sides alike, and ``trimmed``
    tells by how many base pairs; else that is 0.
    """
    pad = ((end - start) * clamp_buffer(buffer, 0.0)).cast("bigint")
    zero = F.lit(0).cast("bigint")
    lo = F.greatest(zero, start - pad)
    hi = end + pad
    excess = zero if limit is None else F.greatest(hi - lo - F.lit(limit), zero)
    trim = F.floor(excess / F.lit(2))
    return F.struct((lo + trim).alias("start"), (hi - (excess - trim)).alias("end"), excess.alias("trimmed"))


def padded_start(pos: Column, padding: int) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), pos - padding)


def padded_end(end: Column, padding: int) -> Column:
    return end + padding


def one_based(start: Column, end: Column) -> Column:
    """Bounds for sequence extraction: start >= 1 and end >= start."""
    lo = F.greatest(F.lit(1).cast("bigint"), start)
    return F.struct(lo.alias("start"), F.greatest(lo, end).alias("end"))


def ordered_bounds(start: Column, end: Column) -> Column:
    """The two bounds swapped when start > end."""
    return F.struct(F.least(start, end).alias("start"), F.greatest(start, end).alias("end"))
