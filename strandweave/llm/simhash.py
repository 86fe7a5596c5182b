"""Near-duplicates by SimHash fingerprints, found with BK-trees.

Fingerprints within the radius agree in at least two of four 16-bit blocks, so
each is put into the six shards that its pairs of blocks name. A shard of more
than ``MAX_SHARD`` fingerprints is cut once more in the same way by the 32 bits
that its key leaves free; what remains has 16 free bits, hence at most 65,536
fingerprints whatever the data. Each shard gets a BK-tree; only edges whose
distance lies within the radius of the distance to the node are followed.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import save, small_batches
from strandweave.llm.graph import components

RADIUS = 2
MAX_SHARD = 4096
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits: each is set if over half of the shingles' hashes have it set; 0 if there is no word.

    ``bytes.split`` cuts at the blank and the five control blanks, and nothing else.
    """
    parts = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    starts, ends = starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        part = zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)
        hashes = np.array([digest(joined[i:j], 42) for i, j in part], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), words: int = 3) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``fp``, the fingerprint as a signed long."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        for batch in small_batches(batches):
            found = [fingerprint(t, words) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.array(found, np.uint64).view(np.int64))], [*batch.schema.names[:-1], "fp"])

    return rows.mapInArrow(run, f"{kinds}, fp long")


class BKTree:
    """Metric tree of distinct 64-bit values: a node's children are keyed by their distance to it."""

    def __init__(self, values=()):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        for v in values:
            self.add(v)

    def add(self, value: int) -> None:
        at = len(self.values)
        if at:
            node = 0
            while True:
                d = (value ^ self.values[node]).bit_count()
                if d == 0:
                    return
                child = self.children[node].get(d)
                if child is None:
                    self.children[node][d] = at
                    break
                node = child
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """All values of the tree at ``radius`` or less."""
        found, stack = [], [0] if self.values else []
        while stack:
            node = stack.pop()
            d = (value ^ self.values[node]).bit_count()
            if d <= radius:
                found.append(self.values[node])
            kids = self.children[node]
            if kids:
                stack.extend(kids[e] for e in range(d - radius, d + radius + 1) if e in kids)
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join what the shard's tree joins: each value to the smallest of its component here."""
    tree, parent = BKTree(values), {v: v for v in values}

    def find(v):
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for v in tree.values:
        for w in tree.within(v, radius):
            a, b = find(v), find(w)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(v, r) for v in tree.values if (r := find(v)) != v]


def _keys(value: Column, blocks: int, bits: int) -> Column:
    """For each pair of the lowest ``blocks`` blocks: pair number and both blocks, in one long."""
    mask = (1 << bits) - 1
    block = [F.shiftrightunsigned(value, bits * i).bitwiseAND(F.lit(mask)) for i in range(blocks)]
    return F.array(*[
        (F.lit(n).cast("long") * F.lit(1 << (2 * bits)) + block[i] * F.lit(1 << bits) + block[j]).cast("long")
        for n, (i, j) in enumerate(combinations(range(blocks), 2))
    ])


def _free_bits(value: Column, pair: Column) -> Column:
    """The 32 bits in the two blocks that are not in the pair."""
    block = [F.shiftrightunsigned(value, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    cases = None
    for n, (i, j) in enumerate(combinations(range(4), 2)):
        k, m = (x for x in range(4) if x not in (i, j))
        free = block[k] * F.lit(1 << 16) + block[m]
        cases = F.when(pair == n, free) if cases is None else cases.when(pair == n, free)
    return cases


def links(distinct: DataFrame, max_shard: int = MAX_SHARD) -> DataFrame:
    """Links ``a, b`` between the fingerprints of ``fp`` (all different) that hold together what lies within the radius."""
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"), 4, 16)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = save(keyed.join(sizes, "key"), "shards")
    pair = F.shiftright("key", 32)
    small = rows.where(F.col("n") <= max_shard).select("key", F.lit(0).cast("long").alias("key2"), "fp")
    large = rows.where(F.col("n") > max_shard).select(
        "key", F.explode(_keys(_free_bits(F.col("fp"), pair), 4, 8)).alias("key2"), "fp")

    def run(batches):
        held, members = None, []
        for batch in batches:
            out = []
            columns = (batch.column(i).to_numpy() for i in range(3))
            for k, k2, fp in zip(*(c.tolist() for c in columns), strict=True):
                if (k, k2) != held:
                    out += shard_links(members, RADIUS) if len(members) > 1 else []
                    held, members = (k, k2), []
                members.append(fp & 0xFFFFFFFFFFFFFFFF)
            yield _link_batch(out)
        if len(members) > 1:
            yield _link_batch(shard_links(members, RADIUS))

    shards = small.union(large).repartition("key", "key2").sortWithinPartitions("key", "key2")
    return shards.mapInArrow(run, "a long, b long").distinct()


def _link_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def groups(fps: DataFrame) -> DataFrame:
    """Per different fingerprint of ``doc_id, fp``: ``fp, component, component_id``.

    ``component`` is the smallest fingerprint that links reach, ``component_id`` the smallest id.
    """
    distinct = save(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = components(links(distinct))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = save(rooted, "roots")
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return save(rooted.join(ids, "root").select("fp", F.col("root").alias("component"), "component_id"), "components")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """Per document ``doc_id, fingerprint, component_id``.

    Null and empty texts have fingerprint zero, linked like any other. Repeated
    rows and equal texts share a fingerprint; a null id is in its component but
    is not what the component is called by, unless it has no other. An empty
    table gives no rows.
    """
    fps = save(fingerprints(docs.select("doc_id", "text"), words=words), "simhash")
    found = fps.join(groups(fps), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest id.

    Of rows that share that id the text of smallest digest stays, once. Groups
    are found on ids, digests and fingerprints; whole rows are moved once.
    """
    id_key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("\0"))))
    slim = docs.select("doc_id", id_key.alias("_id"), digest.alias("_digest"), "text")
    fps = save(fingerprints(slim, keep=("doc_id", "_id", "_digest"), words=words), "simhash")
    grouped = fps.join(groups(fps.select("doc_id", "fp")), "fp")
    first = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # The fingerprint tells components apart that clashing ids call by the same number.
    kept = save(first.groupBy("component", "_id").agg(F.min("_digest").alias("_digest")).select("_id", "_digest"), "kept")
    rows = docs.select(F.struct("*").alias("_row"), id_key.alias("_id"), digest.alias("_digest"))
    return rows.join(kept, ["_id", "_digest"], "left_semi").dropDuplicates(["_id", "_digest"]).select("_row.*")
