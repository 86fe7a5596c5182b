"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import save, small_batches

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
#: A word's ends count as this character; n-grams do not look past them.
EDGE = 0x20
_MULTIPLIERS = {n: np.uint64(0x9E3779B97F4A7C15 + 2 * n) for n in range(1, 9)}


def gram_buckets(text: str, orders=ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket numbers of all n-grams of the whole lower-cased text.

    Characters that are no letters count as one blank, runs of them as one, so
    digits and marks say nothing. Only n-grams that hold a letter are counted.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    low = points < 0x250
    letter = np.zeros(len(points), bool)
    letter[low] = _LATIN[points[low]]
    if not low.all():
        far, back = np.unique(points[~low], return_inverse=True)
        letter[~low] = np.array([chr(c).isalpha() for c in far])[back]
    if not letter.any():
        return np.empty(0, np.int64)
    points = np.where(letter, points, EDGE)
    points = points[letter | np.concatenate([[False], letter[:-1]])]
    points = np.concatenate([[EDGE], points, [EDGE]]).astype(np.uint64)
    blank = points == EDGE
    out, h = [], np.zeros(len(points), np.uint64)
    for n in range(1, max(orders) + 1):
        h = (h[: len(points) - n + 1] + points[n - 1 :]) * np.uint64(0x100000001B3) if n > 1 else points * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
        if n in orders:
            keep = ~blank if n == 1 else ~(blank[: len(h)] & blank[1 : len(h) + 1]) if n == 2 else slice(None)
            mixed = h[keep] * _MULTIPLIERS[n]
            out.append((mixed >> np.uint64(40)).astype(np.int64) % buckets)
    return np.concatenate(out)


_LATIN = np.array([chr(c).isalpha() for c in range(0x250)])


def fit(labelled: DataFrame, max_rows: int = 20_000, smoothing: float = 0.5, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities by bucket, from rows of ``doc_id, text, lang``.

    At most about ``max_rows`` rows of each language are learnt from: those whose
    hash of id and text lies under the share that makes this many. Counts are summed in
    Spark by language and bucket; the model that comes back is languages times
    ``buckets`` numbers, however many rows there are. Rows without text or lang
    are left out. All languages weigh the same beforehand.
    """
    rows = labelled.where("text is not null and lang is not null")
    # One row per language, read from storage: Spark sees its size and need not move the texts.
    sizes = save(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "languages")
    share = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) * F.col("_n")) < F.lit(max_rows << 20)
    sample = rows.join(sizes, "lang").where(share).select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in small_batches(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = gram_buckets(text, buckets=buckets)
                if lang not in sums:
                    sums[lang] = np.zeros(buckets, np.int64)
                sums[lang] += np.bincount(at, minlength=buckets)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())],
                ["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    langs = sorted(set(got.column(0).to_pylist()))
    matrix = np.zeros((buckets, len(langs)))
    at = {lang: i for i, lang in enumerate(langs)}
    matrix[got.column(1).to_numpy(), [at[x] for x in got.column(0).to_pylist()]] = got.column(2).to_numpy()
    matrix += smoothing
    return langs, np.log(matrix / matrix.sum(0, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, keep: tuple[str, ...] = ("doc_id",), inside: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``lang_pred`` and ``score``.

    The text is the column ``text`` or, with ``inside``, that field of this struct
    column, one of ``keep``; so whole rows travel without a second copy of it.

    ``score`` is the posterior probability of the language. Texts that are null
    or have no letter, and all texts if nothing was learnt, are ``und`` with
    score 0. Of languages with equal score the first by code point is told.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix))
    rows = docs.select(*keep, *([] if inside else [F.col("text").cast("string").alias("_text")]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])

    def run(batches):
        names, table = shared.value
        for batch in small_batches(batches):
            found, scores = [], []
            texts = pc.struct_field(batch.column(keep.index(inside)), "text") if inside else batch.column(len(keep))
            for text in texts.to_pylist():
                at = gram_buckets(text, buckets=len(table)) if text and names else ()
                if not len(at):
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                # Sparse: each bucket of the text once, weighed by how often it occurs.
                counts = np.bincount(at)
                hit = np.flatnonzero(counts)
                logs = counts[hit].astype(np.float64) @ table[hit].astype(np.float64)
                best = int(logs.argmax())
                found.append(names[best])
                scores.append(float(1.0 / np.exp(logs - logs[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                [*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def has_letter(text) -> F.Column:
    """Whether a text holds a letter, of any script; false for null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id) -> F.Column:
    """Documents that are not learnt from: CRC-32 of the id as text leaves 1 when divided by 3 (false for null)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Per document ``doc_id, held_out, lang_pred, score``.

    The model learns from documents with text, lang and id that are not held out.
    Only the text is looked at when predicting. Repeated rows and null ids get
    their own rows; an empty table gives none.
    """
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    langs, matrix = fit(labelled, max_rows)
    rows = predict(docs, langs, matrix)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
