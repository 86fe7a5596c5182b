"""Token ids as entropy-coded files: range asymmetric numeral systems with static tables.

A file image is one self-contained binary value; a folder of Parquet rows holds
the images in ascending order of document. An image has

* a shared table: how often each id occurs in it, scaled to ``2**PRECISION``;
* the documents' lengths;
* independent blocks of whole documents. The ids of a block are dealt over
  interleaved lanes, each with a 64-bit state and all with one stream of 32-bit
  words. A block lists checkpoints (all states and the place in the stream), so
  its segments can be decoded apart, and checksums of its words and its ids.

All numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import tokens
from strandweave.llm.common import running_total, save

MAGIC = b"SWR1"
PRECISION = 18
LOW = np.uint64(1 << 31)
LANES = 2048
SEGMENT = 1 << 19
BLOCK = 1 << 20
IMAGE = 1 << 22

FILES = "part long, seq int, n_docs int, n_tokens long, image binary"


def scale_counts(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies that sum to ``2**precision``; each is at least 1."""
    room = 1 << precision
    if not len(counts):
        return counts
    if len(counts) > room:
        raise ValueError("more ids than the table has room for")
    total = counts.sum()
    freq = np.maximum(1, counts * room // max(total, 1)).astype(np.int64)
    extra = room - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if extra > 0:
        freq[order[0]] += extra
    k = 0
    while extra < 0:  # take from the largest what the rounding up of small ones cost
        i = order[k % len(order)]
        take = min(-extra, max(0, int(freq[i]) // 8) or int(freq[i] > 1))
        freq[i] -= take
        extra += take
        k += 1
    return freq


class Table:
    """Ids of one image and their frequencies."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols = symbols.astype(np.uint32)
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.slot: np.ndarray | None = None

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        return cls(symbols, scale_counts(counts[symbols]))

    def slots(self) -> np.ndarray:
        if self.slot is None:
            self.slot = np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freq.astype(np.int64))
        return self.slot


def encode_block(at: np.ndarray, table: Table) -> bytes:
    """One block; ``at`` holds places in the table."""
    n, lanes = len(at), min(LANES, max(1, len(at)))
    steps = -(-n // lanes)
    per_segment = max(1, SEGMENT // lanes)
    freq, cum = table.freq, table.cum
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: dict[int, tuple[int, np.ndarray]] = {}
    emitted = 0
    k, shift = np.uint64(PRECISION), np.uint64(63 - PRECISION)
    for s in range(steps - 1, -1, -1):
        part = at[s * lanes : (s + 1) * lanes]
        f, c = freq[part], cum[part]
        x = state[: len(part)]
        over = x >= (f << shift)
        out = x[over].astype(np.uint32)  # the low 32 bits
        x = np.where(over, x >> np.uint64(32), x)
        q = x // f
        state[: len(part)] = (q << k) + (x - q * f) + c
        words.append(out)
        emitted += len(out)
        if s % per_segment == 0:
            marks[s] = (emitted, state.copy())
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    raw = stream.astype("<u4").tobytes()
    head = [struct.pack("<IIIIII", n, lanes, per_segment, len(marks), len(stream), zlib.crc32(raw))]
    for s in sorted(marks):
        after, states = marks[s]
        head.append(struct.pack("<II", s, emitted - after) + states.astype("<u8").tobytes())
    ids = table.symbols[at].astype("<u4")
    return b"".join(head) + raw + struct.pack("<I", zlib.crc32(ids))


def decode_block(data: memoryview, table: Table) -> tuple[np.ndarray, int]:
    """Ids of the block at the start of ``data`` and how many bytes it takes."""
    n, lanes, per_segment, n_marks, n_words, words_crc = struct.unpack_from("<IIIIII", data)
    pos, marks = 24, []
    for _ in range(n_marks):
        s, w = struct.unpack_from("<II", data, pos)
        marks.append((s, w, np.frombuffer(data, "<u8", lanes, pos + 8).astype(np.uint64)))
        pos += 8 + 8 * lanes
    raw = data[pos : pos + 4 * n_words]
    if zlib.crc32(raw) != words_crc:
        raise ValueError("damaged stream in an id file")
    stream = np.frombuffer(raw, "<u4")
    out = np.empty(n, np.uint32)
    steps = -(-n // lanes) if lanes else 0
    for s, w, states in marks:
        decode_segment(stream, w, states, s, min(steps, s + per_segment), out, table)
    pos += 4 * n_words
    ids = table.symbols[out]
    if zlib.crc32(ids.astype("<u4")) != struct.unpack_from("<I", data, pos)[0]:
        raise ValueError("damaged ids in an id file")
    return ids, pos + 4


def decode_segment(stream, word: int, state, first: int, last: int, out: np.ndarray, table: Table) -> None:
    """Decodes steps ``first`` to ``last`` from a checkpoint into ``out``."""
    lanes, n = len(state), len(out)
    slots, freq, cum = table.slots(), table.freq, table.cum
    mask, k, half = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION), np.uint64(32)
    for s in range(first, last):
        a, b = s * lanes, min(n, (s + 1) * lanes)
        x = state[: b - a]
        low = x & mask
        at = slots[low]
        out[a:b] = at
        x = freq[at] * (x >> k) + low - cum[at]
        need = np.flatnonzero(x < LOW)
        x[need] = (x[need] << half) | stream[word : word + len(need)]
        word += len(need)
        state[: b - a] = x


def encode_image(ids: np.ndarray, sizes: np.ndarray, doc_ids: list) -> bytes:
    """Image of some documents: their ids in a row, how many each has, and what they are called (None allowed)."""
    table = Table.of(ids)
    place = np.zeros(int(table.symbols[-1]) + 1 if len(table.symbols) else 1, np.int64)
    place[table.symbols] = np.arange(len(table.symbols))
    at = place[ids]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    cuts = [0]
    for i in range(1, len(sizes) + 1):
        if i == len(sizes) or bounds[i + 1] - bounds[cuts[-1]] > BLOCK:
            cuts.append(i)
    index = zlib.compress(
        b"".join([table.symbols.astype("<u4").tobytes(), table.freq.astype("<u4").tobytes(), known.tobytes(),
                  names.tobytes(), np.asarray(sizes, "<i8").tobytes()]), 1)
    blocks = [encode_block(at[bounds[a] : bounds[b]], table) for a, b in zip(cuts, cuts[1:], strict=False)]
    head = MAGIC + struct.pack("<IIIII", len(table.symbols), len(sizes), len(blocks), len(index), zlib.crc32(index))
    return b"".join([head, index, *blocks])


def decode_image(image: bytes) -> tuple[np.ndarray, np.ndarray, list]:
    """What ``encode_image`` was given. Raises ValueError if the image is damaged."""
    data = memoryview(image)
    if bytes(data[:4]) != MAGIC:
        raise ValueError("not an id file")
    n_symbols, n_docs, n_blocks, n_index, crc = struct.unpack_from("<IIIII", data, 4)
    pos = 24
    packed = data[pos : pos + n_index]
    if zlib.crc32(packed) != crc:
        raise ValueError("damaged index in an id file")
    index = memoryview(zlib.decompress(packed))
    table = Table(np.frombuffer(index, "<u4", n_symbols), np.frombuffer(index, "<u4", n_symbols, 4 * n_symbols))
    at = 8 * n_symbols
    known = np.frombuffer(index, np.uint8, n_docs, at)
    names = np.frombuffer(index, "<i8", n_docs, at + n_docs)
    sizes = np.frombuffer(index, "<i8", n_docs, at + 9 * n_docs)
    pos += n_index
    out = []
    for _ in range(n_blocks):
        ids, used = decode_block(data[pos:], table)
        out.append(ids)
        pos += used
    ids = np.concatenate(out) if out else np.empty(0, np.uint32)
    return ids, sizes, [int(v) if k else None for v, k in zip(names, known, strict=True)]


def write_ids(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, image_tokens: int = IMAGE) -> None:
    """Writes the ids of all documents to ``folder``, in ascending order of ``doc_id`` (nulls first).

    Documents are dealt to tasks by range of ``doc_id`` and a hash of the text,
    so an id that many rows share does not crowd one task. Each ends with
    ``end_id``; a null text is that alone. A task keeps one image's ids.
    """
    path = tokenizer or tokens.default_path()

    def run(batches):
        enc, part, seq = tokens.encoder(path), TaskContext.get().partitionId(), 0
        ids, sizes, names, held = [], [], [], 0

        def image():
            flat, n = np.concatenate(ids), np.concatenate(sizes)
            data = encode_image(flat, n, names)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([seq], pa.int32()), pa.array([len(n)], pa.int32()),
                 pa.array([len(flat)], pa.int64()), pa.array([data], pa.binary())],
                ["part", "seq", "n_docs", "n_tokens", "image"],
            )

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in tokens.slices(texts):
                new, bounds = enc.encode(texts[lo:hi], end_id)
                ids.append(new)
                sizes.append(np.diff(bounds))
                names += doc_ids[lo:hi]
                held += len(new)
                if held >= image_tokens:
                    yield image()
                    seq += 1
                    ids, sizes, names, held = [], [], [], 0
        if names:
            yield image()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h")
    ordered = ordered.sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    ordered.mapInArrow(run, FILES).write.option("compression", "none").parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of ``folder``: ``doc_id, start, n_tokens, ids_crc32``, all from the decoded ids."""

    def run(batches):
        for batch in batches:
            for start, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, sizes, names = decode_image(image.as_buffer())
                raw, ends = ids.astype("<u4"), np.cumsum(sizes)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends - sizes, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(start + ends - sizes, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.schema(FILES).parquet(folder)
    key = F.col("part") * F.lit(1 << 20) + F.col("seq")
    starts = running_total(files.select(key.alias("key"), "n_tokens"), "key", "n_tokens", "start")
    starts = save(starts.select("key", "start"), "starts")  # one small row per image: Spark sees its size and need not move the images
    images = files.withColumn("key", key).join(starts, "key")
    return images.select("start", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
