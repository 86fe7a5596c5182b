"""DNA strings and k-mers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Match types of a dot plot.
FORWARD, REVERSE, PALINDROME = 1, -1, 2


def reverse_complement(seq: Column) -> Column:
    """Case is kept; letters outside ACGT are kept."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def is_palindrome(kmer: Column) -> Column:
    return kmer == reverse_complement(kmer)


def kmers(seq: Column, k: int) -> Column:
    """All substrings of length k in order; none when the text is shorter than k."""
    if k < 1:
        raise ValueError("k must be >= 1")
    last = F.length(seq) - k
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(seq, i + 1, F.lit(k))),
    )
