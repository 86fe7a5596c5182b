"""Removal of passages that repeat anywhere in a corpus, by a sparse, sorted suffix array.

A window is ``width`` bytes of one document. Every window holds an anchor, the
k-gram in it with the smallest hash, so windows that are equal have equal
anchors at the same place. Neighbouring windows share anchors; such a run is a
segment, and one segment stands for about eighty suffixes.

1. Texts are told apart by digest; each different text is kept once, with its number of copies.
2. Segments whose anchor occurs once are done: nothing in them repeats.
3. If all segments of an anchor are equal, they repeat as wholes.
4. The different segments of the other anchors are cut from the texts and sorted
   with deep-shallow sorting, to both sides of the anchor; common prefixes of
   neighbours tell which windows repeat. An anchor of more than ``max_group``
   different segments is taken apart into windows, which are counted by digest.
5. Windows that repeat are merged into removed runs of their texts.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import save, small_batches
from strandweave.llm.suffix_sort import repeated_windows
from strandweave.session import scratch_folder

WIDTH = 200
GRAM = 40
MAX_GROUP = 4096
#: Positions are kept in the low bits of the hashes that are compared.
_PLACE = 20
_CHUNK = 1 << _PLACE


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` bytes from each position, by doubling."""
    base, h, length, out, done = 0x9E3779B97F4A7C15, data.astype(np.uint64) + np.uint64(1), 1, None, 0
    power = base
    while True:
        if k & length:  # append this power of two to what is hashed so far
            if out is None:
                out, done = h[: len(data) - k + 1], length
            else:
                out = out * np.uint64(power) + h[done : done + len(data) - k + 1]
                done += length
        if 2 * length > k:
            return _mixed(out)
        h = h[: len(h) - length] * np.uint64(power) + h[length:]
        power = power * power & 0xFFFFFFFFFFFFFFFF
        length *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def find_segments(data: np.ndarray, starts: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """Segments of texts that lie one after another in ``data``: text, first window, windows, anchor.

    ``starts`` has where each text begins and, last, where the data end. Places
    are within the text. Of equal hashes the leftmost is the anchor.
    """
    rows = []
    for lo in range(0, max(1, len(data) - width + 1), _CHUNK - 2 * width):
        part = data[lo : lo + _CHUNK]
        n = min(len(part) - width + 1, _CHUNK - 2 * width)
        if n <= 0:
            break
        places = np.arange(len(part) - gram + 1, dtype=np.uint64)
        keys = gram_hashes(part, gram) >> np.uint64(_PLACE) << np.uint64(_PLACE) | places
        anchor = (sliding_min(keys, width - gram + 1)[:n] & np.uint64(_CHUNK - 1)).astype(np.int64) + lo
        window = np.arange(lo, lo + n)
        text = np.searchsorted(starts, window, side="right") - 1
        inside = window + width <= starts[text + 1]
        window, anchor, text = window[inside], anchor[inside], text[inside]
        if not len(window):
            continue
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        first = np.flatnonzero(new)
        count = np.diff(np.concatenate([first, [len(new)]]))
        begin = starts[text[first]]
        rows.append((text[first], window[first] - begin, count, anchor[first] - begin))
    if not rows:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*rows, strict=True))


def distinct_texts(docs: DataFrame, buckets: int) -> DataFrame:
    """Each different text once: ``digest, copies, text``; stored by digest, so later joins by it move no text."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("digest", F.unhex(F.md5("text")))
    texts = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    name = f"texts_{uuid.uuid4().hex}"
    texts.write.option("compression", "zstd").option("path", scratch_folder(spark, name)).bucketBy(buckets, "digest").saveAsTable(name)
    return spark.table(name)


def cut_segments(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """Segments of all texts: ``digest, copies, anchor, content, lo, n, at``; hashes instead of bytes."""

    def run(batches):
        for batch in small_batches(batches):
            digests, copies, raw = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            first = 0
            while first < len(raw):  # texts of about a chunk together
                last, size = first, 0
                while last < len(raw) and (last == first or size + len(raw[last]) <= _CHUNK // 2):
                    size += len(raw[last])
                    last += 1
                joined = b"".join(raw[first:last])
                starts = np.concatenate([[0], np.cumsum([len(t) for t in raw[first:last]])]).astype(np.int64)
                text, lo, n, at = find_segments(np.frombuffer(joined, np.uint8), starts, width, gram)
                if len(text):
                    a = starts[text] + lo
                    b, g = (a + n - 1 + width).tolist(), (starts[text] + at).tolist()
                    digest = xxhash.xxh64_intdigest
                    content = np.array([digest(joined[i:j]) for i, j in zip(a.tolist(), b, strict=True)], np.uint64)
                    anchor = np.array([digest(joined[i : i + gram], 7) for i in g], np.uint64)
                    row = pa.array(text + first)
                    yield pa.RecordBatch.from_arrays(
                        [digests.take(row), copies.take(row), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)),
                         pa.array(lo, pa.int32()), pa.array(n, pa.int32()), pa.array(at - lo, pa.int32())],
                        ["digest", "copies", "anchor", "content", "lo", "n", "at"])
                first = last

    rows = texts.select("digest", "copies", F.col("text").cast("binary").alias("text"))
    rows = rows.where(F.octet_length("text") >= width)
    return rows.mapInArrow(run, "digest binary, copies long, anchor long, content long, lo int, n int, at int")


def _cut_bytes(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The bytes of the wanted segments: ``digest, anchor, lo, at, copies, bytes``."""
    per_text = wanted.groupBy("digest").agg(F.collect_list(F.struct("anchor", "lo", "n", "at", "copies", "crowded")).alias("cuts"))
    rows = texts.select("digest", F.col("text").cast("binary").alias("text")).join(per_text, "digest")

    def run(batches):
        for batch in small_batches(batches):
            out = [[] for _ in range(7)]
            for digest, text, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for c in cuts:
                    part = text[c["lo"] : c["lo"] + c["n"] - 1 + width]
                    values = (digest, c["anchor"], c["lo"], c["at"], c["copies"], c["crowded"], part)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                ["digest", "anchor", "lo", "at", "copies", "crowded", "bytes"])

    return rows.mapInArrow(run, "digest binary, anchor long, lo int, at int, copies long, crowded boolean, bytes binary")


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _sorted_groups(cut: DataFrame, width: int, batch_rows: int = 20_000) -> DataFrame:
    """Repeated byte ranges ``digest, a, b`` of the segments of anchors that are not crowded.

    Whole anchors are sorted together, some thousand segments at a time.
    """

    def run(batches):
        held: list[tuple] = []

        def settle(rows):
            found = repeated_windows([r[3] for r in rows], np.array([r[2] for r in rows]), width)
            hit = [(r[0], r[1] + a, r[1] + b - 1 + width) for r, flags in zip(rows, found, strict=True) if r[4] == 1 for a, b in _runs(flags)]
            return _range_batch(hit)

        for batch in batches:
            digest, anchor, lo, at, copies, data = (c.to_pylist() for c in batch.columns)
            for row in zip(digest, lo, at, data, copies, anchor, strict=True):
                if len(held) >= batch_rows and row[5] != held[-1][5]:
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)

    rows = cut.where("not crowded").select("digest", "anchor", "lo", "at", "copies", "bytes")
    rows = rows.repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(run, "digest binary, a int, b int")


def _range_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["digest", "a", "b"])


def _counted_windows(cut: DataFrame, width: int) -> DataFrame:
    """Repeated windows ``digest, a, b`` of the segments of crowded anchors: counted one by one by digest."""

    def run(batches):
        for batch in small_batches(batches):
            for digest, lo, copies, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(data) - width + 1
                keys = [hashlib.md5(data[i : i + width]).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest] * n, pa.binary()), pa.array(range(lo, lo + n), pa.int32()),
                     pa.array([copies] * n, pa.int64()), pa.array(keys, pa.binary())], ["digest", "a", "copies", "key"])

    rows = cut.where("crowded").select("digest", "lo", "copies", "bytes")
    windows = save(rows.mapInArrow(run, "digest binary, a int, copies long, key binary"), "windows")
    repeated = windows.groupBy("key").agg(F.sum("copies").alias("_n")).where("_n > 1").select("key")
    return windows.where("copies = 1").join(repeated, "key").select("digest", "a", (F.col("a") + width).cast("int").alias("b"))


def repeated_ranges(texts: DataFrame, width: int = WIDTH, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """Byte ranges ``digest, a, b`` of different texts that equal windows elsewhere cover; they may overlap."""
    segments = save(cut_segments(texts, width, gram), "segments")
    # Least and greatest content tell whether an anchor's segments are all equal.
    anchors = segments.groupBy("anchor").agg(
        F.sum("copies").alias("total"), F.min("content").alias("low"), F.max("content").alias("high")).where("total > 1")
    # Stored, so that the join below shuffles both its sides for itself and Spark can split a crowded anchor.
    anchors = save(anchors.select("anchor", (F.col("low") == F.col("high")).alias("alike")), "anchors")
    rows = save(segments.join(anchors, "anchor"), "repeats")
    whole = ("digest", F.col("lo").alias("a"), (F.col("lo") + F.col("n") - 1 + width).cast("int").alias("b"))
    mixed = rows.where("not alike")
    contents = mixed.groupBy("anchor", "content").agg(
        F.sum("copies").alias("total"), F.min(F.struct("digest", "lo", "n", "at")).alias("seg"))
    contents = save(contents, "contents")
    groups = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("_m"), F.min("total").alias("_least")).where("_least = 1")
    wanted = contents.join(groups, "anchor").select(
        "anchor", "seg.*", F.col("total").alias("copies"), (F.col("_m") > max_group).alias("crowded"))
    cut = save(_cut_bytes(texts, wanted, width), "cuts")
    again = save(contents.where("total > 1").select("anchor", "content"), "again")
    ranges = rows.where("alike").select(*whole)
    ranges = ranges.union(mixed.join(again, ["anchor", "content"]).select(*whole))
    return ranges.union(_sorted_groups(cut, width)).union(_counted_windows(cut, width))


def strip(texts: DataFrame, ranges: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per different text what stays: ``digest, n_bytes, n_removed, n_spans, kept`` (bytes) ``, kept_text``.

    A run may end inside a character; ``kept_text`` leaves out the rest of such a character.
    """
    per_text = ranges.groupBy("digest").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    rows = texts.select("digest", "copies", F.col("text").cast("binary").alias("text")).join(per_text, "digest", "left")

    def run(batches):
        for batch in small_batches(batches):
            out = [[] for _ in range(6)]
            columns = (batch.column(i) for i in range(4))
            for digest, copies, text, spans in zip(*(c.to_pylist() for c in columns), strict=True):
                if copies > 1 and len(text) >= width:
                    merged = [[0, len(text)]]
                else:
                    merged = []
                    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                kept, at = [], 0
                for a, b in merged:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                whole, kept = "".join(part.decode("utf-8", "ignore") for part in kept), b"".join(kept)
                for column, value in zip(out, (digest, len(text), len(text) - len(kept), len(merged), kept, whole), strict=True):
                    column.append(value)
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            names = ["digest", "n_bytes", "n_removed", "n_spans", "kept", "kept_text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return rows.mapInArrow(run, "digest binary, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string")


def _stripped(docs: DataFrame, width: int, gram: int, max_group: int) -> DataFrame:
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = distinct_texts(docs, buckets)
    return strip(texts, repeated_ranges(texts, width, gram, max_group), width)


def _digest(text):
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def removed_passages(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """Per document ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A null text is empty. Equal texts of ``width`` bytes or more are removed
    whole, each of them; so are repeated rows. Null ids stay null. An empty table
    gives no rows.
    """
    found = _stripped(docs, width, gram, max_group).select(
        "digest", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    rows = docs.select("doc_id", _digest(F.col("text")).alias("digest"))
    return rows.join(found, "digest").drop("digest")


def remove_passages(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """``docs`` with all columns, ``text`` without its repeated passages.

    Bytes are removed, so a run may end inside a character; the pieces of such a
    character are dropped. Null texts stay null, and a text may become empty.
    """
    found = _stripped(docs, width, gram, max_group).select("digest", F.col("kept_text").alias("_kept"))
    # The old texts stay behind: only the other columns and the digest are moved.
    others = F.struct(*[F.col(c) for c in docs.columns if c != "text"], F.col("text").isNotNull().alias("_known"))
    rows = docs.select(others.alias("_row"), _digest(F.col("text")).alias("digest"))
    text = F.when(F.col("_row._known"), F.col("_kept"))
    columns = [text.alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return rows.join(found, "digest").select(*columns)
