"""Packing of tokenized documents into sequences by fitted length patterns.

The plan is made from the histogram of lengths alone, which has at most
``seq_len`` entries however many documents there are: patterns of up to three
documents that fill a sequence are enumerated over length bins, non-negative
least squares fits their repeat counts to the histogram, the counts are rounded,
and what is left is packed best-fit, longest first, into the gaps and into new
sequences. Documents then find their places by a rank within their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm import tokens
from strandweave.llm.common import save, small_batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, first_rank long, end_rank long, first_sequence long, copies long, at long"


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, seq_len: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of each document's ids: at most ``seq_len`` long, all but the first exactly that.

    A null or empty text is its end id alone. Repeated rows give repeated
    pieces; other columns are not looked at.
    """
    path = tokenizer or tokens.default_path()

    def run(batches):
        enc = tokens.encoder(path)
        for batch in small_batches(batches):
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in tokens.slices(texts):
                ids, bounds = enc.encode(texts[lo:hi], end_id)
                raw = ids.astype("<u4")
                sizes = np.diff(bounds)
                per = (sizes + seq_len - 1) // seq_len
                row = np.repeat(np.arange(hi - lo), per)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
                head = sizes - (per - 1) * seq_len
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * seq_len)
                length = np.where(piece == 0, head[row], seq_len)
                a = bounds[row] + start
                crc = [zlib.crc32(raw[i:j]) for i, j in zip(a, a + length, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(row + lo)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def bin_patterns(bins: int) -> np.ndarray:
    """All multisets of one to three bin numbers that sum to ``bins``; 0 stands for no document."""
    rows = [
        (a, b, bins - a - b)
        for a in range(bins, 0, -1)
        for b in range(min(a, bins - a), -1, -1)
        if 0 <= bins - a - b <= b
    ]
    return np.array(rows, np.int64)


def nnls(a: np.ndarray, target: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that makes ``a @ x`` nearest to ``target``, by the active-set method."""
    m, n = a.shape
    corr = a.T @ target
    x, on = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(corr).max(initial=0.0)))
    for _ in range(rounds):
        slope = corr - a.T @ (a @ x)
        slope[on] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= tol or on.sum() >= m:
            break
        on[j] = True
        while True:
            at = np.flatnonzero(on)
            z = np.linalg.lstsq(a[:, at], target, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            bad = at[z <= 0]
            step = min(x[k] / (x[k] - z[at == k][0]) if x[k] > z[at == k][0] else 0.0 for k in bad)
            x[at] += step * (z - x[at])
            on[at[x[at] <= 1e-12]] = False
            x[~on] = 0
            if not on.any():
                break
    return x


@dataclass
class Run:
    """``count`` sequences that hold the same lengths in the same order."""

    count: int
    items: list[tuple[int, int]] = field(default_factory=list)  # (length, copies)

    def used(self) -> int:
        return sum(length * copies for length, copies in self.items)

    def with_item(self, count: int, length: int, copies: int) -> Run:
        return Run(count, [*self.items, (length, copies)])


def plan_runs(histogram: dict[int, int], seq_len: int = 2048, widths: tuple[int, ...] = (8, 16), filler: int = 64) -> list[Run]:
    """The plan with the fewest sequences of those over bins of each of ``widths``.

    Its cost depends on ``seq_len`` alone, not on the number of documents.
    """
    plans = (plan_by_bins(histogram, seq_len, width, filler) for width in widths)
    return min(plans, key=lambda runs: sum(r.count for r in runs))


def plan_by_bins(histogram: dict[int, int], seq_len: int, width: int, filler: int) -> list[Run]:
    """Sequences for ``histogram`` (length -> documents, 1 to ``seq_len``); every document has one place.

    Patterns count lengths in bins of ``width``. A pattern places its two longest
    documents; its third place is left to the residual packing, which fills it
    with the longest document that fits rather than with one of the same bin.
    Documents of up to ``filler`` tokens are in no pattern and fill gaps.
    """
    if any(not 1 <= length <= seq_len for length in histogram):
        raise ValueError("lengths must be from 1 to seq_len")
    left = {k: v for k, v in sorted(histogram.items()) if v > 0}
    runs: list[Run] = []
    if n := left.pop(seq_len, 0):
        runs.append(Run(n, [(seq_len, 1)]))
    width = min(width, seq_len)
    fits = seq_len // width  # bins a sequence holds; a document counts as its length rounded up to whole bins
    stock: dict[int, list[list[int]]] = defaultdict(list)  # bin -> [length, count], longest last
    for length, count in left.items():
        stock[-(-length // width)].append([length, count])
    have = np.zeros(fits + 2, np.int64)
    for b, rows in stock.items():
        have[b] = sum(c for _, c in rows)
    patterns = bin_patterns(fits)
    patterns = patterns[(patterns == 0).sum(1) < 2]
    free = (have > 0) & (np.arange(len(have)) * width > filler)
    patterns = patterns[((patterns == 0) | free[patterns]).all(1)]
    if len(patterns):
        a = np.zeros((fits + 1, len(patterns)))
        for k in range(3):
            np.add.at(a, (patterns[:, k], np.arange(len(patterns))), 1.0)
        a[0] = 0
        x = nnls(a, have[: fits + 1].astype(float))
        for p in np.argsort(-x, kind="stable"):
            parts = [int(b) for b in patterns[p] if b][:2]  # the third place goes to what fits best, below
            need = {b: parts.count(b) for b in parts}
            repeat = min(int(x[p]), *(int(have[b]) // m for b, m in need.items()))
            for b in parts:
                have[b] -= repeat
            while repeat > 0:
                picked, count = [], repeat
                for b in need:
                    rows, want = stock[b], need[b]
                    while want:  # copies of one bin may come from several lengths
                        length, there = rows[-1]
                        take = min(want, there)
                        count = min(count, there // take)
                        picked.append((b, length, take))
                        want -= take
                        if want:
                            rows = rows[:-1]
                for b, length, take in picked:
                    row = next(r for r in reversed(stock[b]) if r[0] == length)
                    row[1] -= take * count
                    if not row[1]:
                        stock[b].remove(row)
                runs.append(Run(count, [(length, take) for _, length, take in picked]))
                repeat -= count
    rest = sorted(((length, count) for rows in stock.values() for length, count in rows), reverse=True)
    return _best_fit(runs, rest, seq_len)


def _best_fit(runs: list[Run], rest: list[tuple[int, int]], seq_len: int) -> list[Run]:
    """Puts the rest, longest first, each into the fullest sequence that has room."""
    gaps: dict[int, list[Run]] = defaultdict(list)
    number = np.zeros(seq_len + 1, np.int64)

    def put(run: Run) -> None:
        gap = seq_len - run.used()
        gaps[gap].append(run)
        number[gap] += 1

    for run in runs:
        put(run)
    for length, count in rest:
        while count:
            open_gaps = np.flatnonzero(number[length:])
            if len(open_gaps):
                gap = length + int(open_gaps[0])
                run = gaps[gap].pop()
                number[gap] -= 1
            else:
                gap, run = seq_len, Run(-(-count // (seq_len // length)))
            each = gap // length
            full = min(run.count, count // each)
            if full:
                put(run.with_item(full, length, each))
                count -= full * each
            spare = run.count - full
            if spare and count:  # one sequence takes the few that are left
                put(run.with_item(1, length, count))
                count, spare = 0, spare - 1
            if spare:
                if run.items:
                    put(Run(spare, run.items))
    return [run for group in gaps.values() for run in group]


def plan_rows(runs: list[Run]) -> list[tuple[int, int, int, int, int, int]]:
    """Rank ranges of each length: where its documents go."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for run in runs:
        at = 0
        for length, copies in run.items:
            n = run.count * copies
            rows.append((length, rank[length], rank[length] + n, sequence, copies, at))
            rank[length] += n
            at += length * copies
        sequence += run.count
    return rows


def pack(docs: DataFrame, tokenizer: str | None = None, seq_len: int = 2048, end_id: int = 0, salts: int = 1024) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    Sequences have no gaps; none is longer than ``seq_len``. An empty table
    gives no rows. Repeated rows and null ids are packed like any others.

    Ranks within a length are counted in ``salts`` parts, so a length that most
    documents share is spread over as many tasks.
    """
    pieces = save(cut_pieces(docs, tokenizer, seq_len, end_id), "pieces")
    spark = pieces.sparkSession
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    parts = pieces.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    parts = save(parts, "lengths")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rows = plan_rows(plan_runs(histogram, seq_len))
    plan = spark.createDataFrame(rows, PLAN)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        pieces.withColumn("_row", F.row_number().over(within))
        .join(bases, ["length", "_salt"])
        .withColumn("_rank", F.col("_base") + F.col("_row") - 1)
    )
    # The plan follows the histogram, which seq_len bounds, and not the documents.
    placed = ranked.join(F.broadcast(plan), "length").where("_rank >= first_rank and _rank < end_rank")
    within_range = F.col("_rank") - F.col("first_rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(within_range / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(within_range, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )
