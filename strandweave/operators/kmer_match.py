"""K-mer dot plots of many sequence pairs in one job."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import dna
from strandweave.functions.kmer_arrays import Matches

# Letters cut out at once, so that no row holds the k-mers of a whole sequence.
PIECE = 512
# Pairs of up to so many letters a side are matched where they lie; longer ones are joined by k-mer.
WHOLE = 1 << 16
# Matches in a batch.
BATCH = 1 << 18


def _pieces(seqs: DataFrame, k: int, seq: str, key: tuple[str, ...]) -> DataFrame:
    """``key, at, piece``: a sequence cut in one pass over its text; each piece borrows the next one's first letters."""
    if k < 1:
        raise ValueError("k must be >= 1")
    size = max(PIECE, k)
    parts = F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{size}}}"), 0)
    cut = seqs.filter(F.length(seq) >= k).select(*key, parts.alias("parts"))
    ahead = F.substring(F.coalesce(F.get("parts", F.col("n") + 1), F.lit("")), 1, k - 1)
    pieces = cut.select(*key, "parts", F.posexplode("parts").alias("n", "part")).select(
        *key, (F.col("n") * size).alias("at"), F.concat("part", ahead).alias("piece")
    )
    return pieces.filter(F.length("piece") >= k)


def shingle(seqs: DataFrame, k: int, seq: str, pos: str, key: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """``key, pos, kmer``; k-mers holding an uppercase N are left out."""
    return (
        _pieces(seqs, k, seq, key)
        .select(*key, "at", F.posexplode(dna.kmers(F.col("piece"), k)).alias("p", "kmer"))
        .filter(~F.col("kmer").contains("N"))
        .select(*key, (F.col("at") + F.col("p")).alias(pos), "kmer")
    )


def shingle_extent(seqs: DataFrame, k: int, seq: str, key: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """``key, n, lo, hi, places``: of the k-mers of ``shingle`` their number, first, last and sum of positions.

    Each piece is reduced where it is cut out; no k-mer is a row.
    """
    kmer = F.transform(dna.kmers(F.col("piece"), k), lambda x, p: F.struct(x.alias("kmer"), (F.col("at") + p).cast("bigint").alias("pos")))
    kept = F.filter(kmer, lambda x: ~x["kmer"].contains("N"))
    held = _pieces(seqs, k, seq, key).select(*key, F.explode(F.array(kept)).alias("kept")).where(F.size("kept") > 0)
    some = held.select(
        *key, F.size("kept").alias("n"), F.array_min("kept")["kmer"].alias("lo"), F.array_max("kept")["kmer"].alias("hi"),
        F.aggregate("kept", F.lit(0).cast("bigint"), lambda s, x: s + x["pos"]).alias("places"),
    )
    return some.groupBy(*key).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("places").alias("places"))


def _sought(starts: DataFrame, *extra: str) -> DataFrame:
    """Each row of ``starts`` under the k-mers that match it, with the type of match.

    Equal k-mers give type 1, or 2 when the k-mer is its own reverse complement;
    any other is sought under its reverse complement too, with type -1.
    """
    rc = F.col("rc")
    own = F.struct(F.col("kmer"), F.when(F.col("kmer") == rc, dna.PALINDROME).otherwise(dna.FORWARD).alias("match_type"))
    turned = F.struct(rc.alias("kmer"), F.lit(dna.REVERSE).alias("match_type"))
    ways = F.when(F.col("kmer") == rc, F.array(own)).otherwise(F.array(own, turned))
    with_rc = starts.withColumn("rc", dna.reverse_complement(F.col("kmer")))
    return with_rc.select(*extra, F.explode(ways).alias("w")).select(*extra, "w.kmer", "w.match_type")


def _whole() -> Column:
    """Whether both sides are short enough to be matched where they lie."""
    return F.coalesce(F.greatest(F.length("seq1"), F.length("seq2")), F.lit(0)) <= WHOLE


def _long_sides(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pair_id, bases`` of either side of the longer pairs.

    Sides are told apart only after the rows of ``pairs``, so that whatever
    makes these is the same for all uses and runs once.
    """
    side = lambda n: F.struct(F.lit(n).alias("side"), F.col(f"seq{n}").alias("bases"))
    sides = pairs.where(~_whole()).select("pair_id", F.explode(F.array(side(1), side(2))).alias("s")).select("pair_id", "s.*")
    return sides.where("side = 1").drop("side"), sides.where("side = 2").drop("side")


def _pairs_of(batch: pa.RecordBatch, k: int):
    for key, a, b in zip(*(batch.column(c) for c in ("pair_id", "seq1", "seq2")), strict=True):
        yield key, Matches(a.as_py() or "", b.as_py() or "", k)


def _short_matches(pairs: DataFrame, k: int, cap: int | None) -> DataFrame:
    kind = pairs.schema["pair_id"].dataType.simpleString()

    def match(batches):
        keys, made, n = [], [], 0

        def batch():
            ids = pa.array([key for key, _ in keys], keys[0][0].type).take(pa.array(np.repeat(np.arange(len(keys)), [m for _, m in keys])))
            return pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(c)) for c in zip(*made, strict=True))], ["pair_id", "i", "j", "match_type"])

        for given in batches:
            for key, found in _pairs_of(given, k):
                for rows in found.rows(BATCH, cap):
                    keys.append((key, len(rows[0])))
                    made.append(rows)
                    n += len(rows[0])
                    if n >= BATCH:
                        yield batch()
                        keys, made, n = [], [], 0
        if n:
            yield batch()

    return pairs.select("pair_id", "seq1", "seq2").mapInArrow(match, f"pair_id {kind}, i int, j int, match_type int")


def _short_counts(pairs: DataFrame, k: int) -> DataFrame:
    kind = pairs.schema["pair_id"].dataType.simpleString()

    def count(batches):
        for given in batches:
            totals = [found.totals() for _, found in _pairs_of(given, k)]
            if totals:
                kinds = [pa.array(c, pa.int64()) for c in zip(*totals, strict=True)]
                yield pa.RecordBatch.from_arrays([given.column("pair_id"), *kinds], ["pair_id", "forward", "reverse", "palindrome"])

    return pairs.select("pair_id", "seq1", "seq2").mapInArrow(count, f"pair_id {kind}, forward long, reverse long, palindrome long")


def dotplot_matches(pairs: DataFrame, k: int = 31, cap: int | None = None) -> DataFrame:
    """``pair_id, i, j, match_type`` for ``pairs(pair_id, seq1, seq2)``, ``pair_id`` unique.

    A match joins equal k-mers (type 1, or 2 when the k-mer is its own reverse
    complement) or a k-mer and its reverse complement (type -1). All of them are
    reported. Pairs of up to ``WHOLE`` letters a side are matched in the task
    that holds them; longer ones are joined on pair and k-mer, and Spark splits
    those that crowd. With a ``cap``, matches count in order of i, then forward
    before reverse, then j, and each pair's first ``cap`` are reported.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    first, second = _long_sides(pairs)
    starts, ends = shingle(first, k, "bases", "i"), shingle(second, k, "bases", "j")
    found = _sought(starts, "pair_id", "i").join(ends, ["pair_id", "kmer"])
    if cap is not None:
        turn = F.col("match_type") == dna.REVERSE
        place = Window.partitionBy("pair_id").orderBy("i", turn, "j")
        found = found.withColumn("ord", F.row_number().over(place)).filter(F.col("ord") <= cap)
    return _short_matches(pairs.where(_whole()), k, cap).unionByName(found.select("pair_id", "i", "j", "match_type"))


def kmer_counts(seqs: DataFrame, k: int, seq: str, key: tuple[str, ...]) -> DataFrame:
    """``key, kmer, n``: how often each k-mer occurs in each sequence."""
    return shingle(seqs, k, seq, "pos", key).groupBy(*key, "kmer").agg(F.count(F.lit(1)).alias("n"))


def match_counts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per pair the matches of each type, from ``pair_id, kmer, n`` of both sequences.

    Products of counts are summed; no match is built.
    """
    met = _sought(first.withColumnRenamed("n", "n1"), "pair_id", "n1").join(
        second.select("pair_id", "kmer", F.col("n").alias("n2")), ["pair_id", "kmer"]
    )
    kind = lambda t: F.coalesce(F.sum(F.when(F.col("match_type") == t, F.col("n1") * F.col("n2"))), F.lit(0).cast("bigint"))
    return met.groupBy("pair_id").agg(
        kind(dna.FORWARD).alias("forward"), kind(dna.REVERSE).alias("reverse"), kind(dna.PALINDROME).alias("palindrome")
    )


def summarise(pairs: DataFrame, counts: DataFrame, k: int, cap: int | None = None) -> DataFrame:
    """``pair_id, seq1_len, seq2_len`` of ``pairs`` with their counts; pairs without a match have zeros."""
    none = F.lit(0).cast("bigint")
    kinds = ("forward", "reverse", "palindrome")
    out = pairs.join(counts, "pair_id", "left")
    out = out.withColumns({c: F.coalesce(c, none) for c in kinds}).withColumn("k", F.lit(k))
    total = F.col("forward") + F.col("reverse") + F.col("palindrome")
    return out.withColumn("truncated", F.lit(False) if cap is None else total >= cap)


def dotplot_summary(pairs: DataFrame, k: int = 31, cap: int | None = None) -> DataFrame:
    """Per pair the matches of each type, both lengths, k and whether a cap was reached."""
    sizes = pairs.select(
        "pair_id",
        F.length(F.coalesce("seq1", F.lit(""))).alias("seq1_len"),
        F.length(F.coalesce("seq2", F.lit(""))).alias("seq2_len"),
    )
    if cap is None:
        if k < 1:
            raise ValueError("k must be >= 1")
        counts = match_counts(*(kmer_counts(side, k, "bases", ("pair_id",)) for side in _long_sides(pairs)))
        return summarise(sizes, _short_counts(pairs.where(_whole()), k).unionByName(counts), k)
    kind = lambda t: F.count_if(F.col("match_type") == t)
    counts = dotplot_matches(pairs, k, cap).groupBy("pair_id").agg(
        kind(dna.FORWARD).alias("forward"), kind(dna.REVERSE).alias("reverse"), kind(dna.PALINDROME).alias("palindrome")
    )
    return summarise(sizes, counts, k, cap)
