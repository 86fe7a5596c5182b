"""Sequence chunks, name resolution and slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from strandweave.functions.regions import format_region
from strandweave.session import stored

CHUNK = 10_000


def chunk_sequences(seqs: DataFrame, size: int = CHUNK) -> DataFrame:
    """``genome, name, chunk, bases``: long sequences cut into pieces of ``size`` letters, in one pass over each."""
    pieces = F.regexp_extract_all(F.col("seq"), F.lit(f"(?s).{{1,{size}}}"), 0)
    some = F.when(F.length("seq") == 0, F.array(F.lit(""))).otherwise(pieces)
    return seqs.select("genome", "name", F.posexplode(some).alias("chunk", "bases"))


def _touched(spans: DataFrame, chunks: DataFrame, key: Sequence[str], size: int) -> DataFrame:
    """``key, genome, name, lo, hi`` of spans with each ``chunk`` that they touch and its ``bases``.

    A span may be asked for far beyond the end of its sequence. It has rows up to
    the last chunk only, so there are no more than chunks are there to be read;
    chunks are stored for that, as they are read twice.
    """
    kept = stored(chunks, "chunks")
    ends = kept.groupBy("genome", "name").agg(F.max("chunk").cast("bigint").alias("_last"))
    lo, hi = F.greatest("start", F.lit(1).cast("bigint")), F.col("end")
    chunk_of = lambda p: F.floor((p - 1) / F.lit(size)).cast("bigint")
    asked = spans.filter(hi >= lo).select(*dict.fromkeys([*key, "genome", "name"]), lo.alias("lo"), hi.alias("hi"))
    inside = asked.join(ends, ["genome", "name"]).where(chunk_of(F.col("lo")) <= F.col("_last"))
    each = F.sequence(chunk_of(F.col("lo")), F.least(chunk_of(F.col("hi")), "_last"))
    each = F.explode(each.cast(ArrayType(kept.schema["chunk"].dataType)))
    return inside.withColumn("chunk", each).drop("_last").join(kept, ["genome", "name", "chunk"])


def slice_sequences(
    spans: DataFrame, chunks: DataFrame, key: Sequence[str] = ("region_id",), size: int = CHUNK
) -> DataFrame:
    """Adds ``bases``: letters ``start..end`` (1-based inclusive) of ``genome, name``.

    A span is joined to the chunks it touches, so only those are read into it.
    Spans past the end of the sequence are shortened; the bases are null when
    the name is unknown.
    """
    key = list(key)
    first = F.greatest(F.col("lo") - F.col("chunk") * F.lit(size).cast("bigint"), F.lit(1).cast("bigint"))
    last = F.least(F.col("hi") - F.col("chunk") * F.lit(size).cast("bigint"), F.lit(size).cast("bigint"))
    parts = _touched(spans, chunks, key, size).select(
        *key, "chunk",
        F.substring("bases", first.cast("int"), (last - first + 1).cast("int")).alias("part"),
    )
    whole = parts.groupBy(*key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"]), ""
        ).alias("bases")
    )
    return spans.join(whole, key, "left")


def slice_parts(
    spans: DataFrame, chunks: DataFrame, key: Sequence[str] = ("region_id",), size: int = CHUNK, part: int = CHUNK
) -> DataFrame:
    """``key, part_no, bases``: the slices of ``slice_sequences`` in pieces of ``part`` letters, counted from each slice's start.

    No row holds more than ``part`` letters, however long a slice is; a piece is
    put together from the chunks that it touches, and only pieces that lie in
    more than one are moved for that. Spans without letters, past
    the end or of unknown names, have no rows.
    """
    key = list(key)
    step = lambda p, n: F.floor(p / F.lit(n)).cast("bigint")
    before = F.col("chunk").cast("bigint") * size
    found = _touched(spans, chunks, key, size).select(
        *key, "lo", "hi", "bases", before.alias("before"), F.greatest(F.col("lo"), before + 1).alias("a"), F.least(F.col("hi"), before + F.length("bases")).alias("b")
    ).filter("b >= a")
    cut = found.withColumn("part_no", F.explode(F.sequence(step(F.col("a") - F.col("lo"), part), step(F.col("b") - F.col("lo"), part))))
    first = F.greatest("a", F.col("lo") + F.col("part_no") * part)
    last = F.least("b", F.col("lo") + (F.col("part_no") + 1) * part - 1)
    bases = F.substring("bases", (first - F.col("before")).cast("int"), (last - first + 1).cast("int"))
    # One generated row keeps the filters below from being pushed under the join, so that both read the same shuffled rows.
    whole = (last - first + 1 == part) | (last == F.col("hi")) & (first == F.col("lo") + F.col("part_no") * part)
    pieces = cut.select(*key, "part_no", F.explode(F.array(F.struct(first.alias("a"), bases.alias("bases"), whole.alias("whole")))).alias("p"))
    pieces = pieces.select(*key, "part_no", "p.*")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "bases"))), lambda x: x["bases"]), "")
    split = pieces.where(~F.col("whole")).groupBy(*key, "part_no").agg(joined.alias("bases"))
    return pieces.where("whole").select(*key, "part_no", "bases").unionByName(split)


def resolve_names(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """Sequence and local bounds for each region; unresolved regions are left out.

    ``regions(region_id, genome, chrom, start, end)`` and ``contigs(genome,
    contig_ord, name, length)``. The first contig of the genome in index order wins whose name is the whole
    region text, or the contig, or begins with the contig followed by a
    character that is no letter or digit. The last rule becomes an equi-join by
    listing, for each name, its prefixes that end before such a character.
    """
    asked = regions.filter(F.col("end") >= F.col("start")).withColumn(
        "text", format_region(F.col("chrom"), F.col("start"), F.col("end"))
    )
    by = F.explode(
        F.array(
            F.struct(F.col("text").alias("term"), F.lit(1).alias("rule")),
            F.struct(F.col("chrom").alias("term"), F.lit(2).alias("rule")),
        )
    ).alias("q")
    terms = asked.select("region_id", "genome", "start", "end", by).select(
        "region_id", "genome", "start", "end", "q.term", "q.rule"
    )
    cut = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length("name") - 1, F.lit(1))),
        lambda i: F.substring("name", i + 1, F.lit(1)).rlike("[^A-Za-z0-9]"),
    )
    shorter = F.transform(cut, lambda i: F.substring("name", F.lit(1), i))
    names = contigs.select(
        "genome", "contig_ord", "name", "length",
        F.explode(
            F.concat(
                F.array(F.struct(F.col("name").alias("term"), F.lit(True).alias("full"))),
                F.transform(shorter, lambda t: F.struct(t.alias("term"), F.lit(False).alias("full"))),
            )
        ).alias("t"),
    ).select("genome", "contig_ord", "name", "length", F.col("t.term").alias("term"), F.col("t.full").alias("full"))
    hits = terms.join(names, ["genome", "term"]).filter(F.col("full") | (F.col("rule") == 2))
    rule = F.when(F.col("full"), F.col("rule")).otherwise(3)
    best = hits.groupBy("region_id", "genome").agg(
        F.min(F.struct("contig_ord", rule.alias("rule"), "name", "length", "start", "end")).alias("b")
    )
    local = F.col("b.rule") != 2
    return best.select(
        "region_id", "genome", F.col("b.name").alias("name"),
        F.when(local, F.lit(1).cast("bigint")).otherwise(F.col("b.start")).alias("start"),
        F.when(local, F.least("b.length", F.col("b.end") - F.col("b.start") + 1))
        .otherwise(F.col("b.end")).alias("end"),
    )
