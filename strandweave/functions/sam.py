"""SAM flags, tags and genotypes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM flag bits.
UNMAPPED, REVERSED, SECONDARY = 0x4, 0x10, 0x100


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def is_mapped(flags: Column) -> Column:
    return ~has_flag(flags, UNMAPPED)


def has_score(flags: Column, as_score: Column) -> Column:
    """Mapped and carrying an alignment score: the reads that take part in phasing."""
    return is_mapped(flags) & as_score.isNotNull()


def int_tag(fields: Column, tag: str) -> Column:
    """Value of an integer tag ``XX:i:n``; null when absent or not an integer."""
    hits = F.filter(fields, lambda x: x.startswith(f"{tag}:"))
    return F.regexp_extract(F.get(hits, F.lit(0)), rf"^{tag}:[cCsSiI]:(-?\d+)$", 1).try_cast("int")


def genotype(sample_field: Column) -> Column:
    """Text before the first colon with ``/`` written as ``|``."""
    return F.replace(F.split(sample_field, ":")[0], F.lit("/"), F.lit("|"))
