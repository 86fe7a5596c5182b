"""Byte-level BPE encoding by tree concatenation, and decoding.

Texts of up to ``LEAF`` characters are encoded where they are. A longer one is
cut into leaves that other tasks encode. A cut before a blank or newline that
follows a letter, digit or ASCII mark is always a cut of the pre-tokenizer, so
ids on both sides stand as they are. Where a stretch has no such place it is
unsplit text: it is cut anywhere, its halves are encoded on their own, and the
tree of halves is put together again. Each join looks at a window that grows
until both sides agree:

* Pre-tokens. Scanning goes left to right and has no memory, and no decision
  looks more than two characters ahead. So all pre-tokens of the left half but
  the last two are right; scanning goes on from there into the right half until
  it meets a cut that the right half has too.
* Tokens. A pre-token that lies across the join is the left half's tokens, then
  the right half's. ``k`` tokens of each side are encoded again; if the result
  begins with the first and ends with the last of them, every pair of
  neighbouring tokens is one that encoding keeps apart, which makes the whole
  sequence the encoding. Otherwise ``k`` doubles.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import save
from strandweave.llm.tokens import byte_alphabet, default_path, encoder, slices

LEAF = 16_384
_MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


@dataclass
class Part:
    """An encoded stretch: its pre-tokens' first characters and first tokens, and the ids."""

    text: str
    starts: np.ndarray
    first: np.ndarray
    ids: np.ndarray

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids of the pre-tokens ``a`` to ``b - 1``."""
        end = self.first[b] if b < len(self.first) else len(self.ids)
        return self.ids[self.first[a] : end] if a < b else self.ids[:0]

    def boundary(self, place: int) -> int | None:
        """How many pre-tokens end at ``place`` or before it; None if one lies across it."""
        at = int(np.searchsorted(self.starts, place))
        if place == len(self.text) or (at < len(self.starts) and self.starts[at] == place):
            return at
        return None


class Tree:
    """Encodes one unsplit stretch from halves, with the tokenizer's own model and pre-tokenizer."""

    def __init__(self, tokenizer):
        self.model, self.pre, self.name = tokenizer.model, tokenizer.pre_tokenizer, tokenizer.id_to_token

    def _bpe(self, mapped: str) -> np.ndarray:
        return np.array([t.id for t in self.model.tokenize(mapped)], np.uint32)

    def leaf(self, text: str) -> Part:
        pieces = self.pre.pre_tokenize_str(text)
        return self._part(text, [at for _, (at, _) in pieces], [self._bpe(mapped) for mapped, _ in pieces])

    @staticmethod
    def _part(text: str, starts, ids: list[np.ndarray]) -> Part:
        first = np.concatenate([[0], np.cumsum([len(i) for i in ids])])[:-1].astype(np.int64)
        return Part(text, np.array(starts, np.int64), first, np.concatenate(ids) if ids else np.empty(0, np.uint32))

    def concat(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of one pre-token from the ids of its two halves."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        k = 2
        while True:
            a, b = left[-k:], right[:k]
            new = self._bpe("".join(map(self.name, a.tolist() + b.tolist())))
            if (k >= len(left) or new[0] == a[0]) and (k >= len(right) or new[-1] == b[-1]):
                return np.concatenate([left[:-k] if k < len(left) else left[:0], new, right[k:]])
            k *= 2

    def join(self, left: Part, right: Part) -> Part:
        """The encoding of ``left.text + right.text``."""
        if not len(left.starts) or not len(right.starts):
            return right if not len(left.starts) else left
        cut, end = len(left.text), len(right.text)
        keep = max(0, len(left.starts) - 2)
        base, width = int(left.starts[keep]), 64
        while True:
            pieces = self.pre.pre_tokenize_str(left.text[base:] + right.text[:width])
            sure = pieces if width >= end else pieces[:-2]
            spans, meet = [], None
            for mapped, (a, b) in sure:
                spans.append((mapped, base + a, base + b))
                if base + b >= cut and (meet := right.boundary(base + b - cut)) is not None:
                    break
            if meet is not None:
                break
            width *= 2
        starts = [left.starts[:keep], [a for _, a, _ in spans], right.starts[meet:] + cut]
        middle = [self._span(left, right, *s) for s in spans]
        ids = [left.tokens(0, keep), *middle, right.tokens(meet, len(right.starts))]
        sizes = np.concatenate([[len(ids[0])], [len(m) for m in middle]]).cumsum()
        first = np.concatenate([left.first[:keep], sizes[:-1], right.first[meet:] - (right.first[meet] if meet < len(right.first) else 0) + sizes[-1]])
        return Part(left.text + right.text, np.concatenate(starts).astype(np.int64), first.astype(np.int64), np.concatenate(ids))

    def _span(self, left: Part, right: Part, mapped: str, a: int, b: int) -> np.ndarray:
        """Ids of the pre-token at ``a`` to ``b - 1`` of both texts together."""
        cut = len(left.text)
        i, i2 = (left.boundary(min(x, cut)) for x in (a, b))
        j, j2 = (right.boundary(max(x - cut, 0)) for x in (a, b))
        if None in (i, i2, j, j2):
            return self._bpe(mapped)
        parts = [left.tokens(k, k + 1) for k in range(i, i2)] + [right.tokens(k, k + 1) for k in range(j, j2)]
        out = parts[0]
        for part in parts[1:]:
            out = self.concat(out, part)
        return out

    def whole(self, parts: list[Part]) -> Part:
        """All parts of an unsplit stretch, joined two by two."""
        while len(parts) > 1:
            pairs = [self.join(a, b) for a, b in zip(parts[::2], parts[1::2], strict=False)]
            parts = pairs + parts[len(pairs) * 2 :]
        return parts[0]


def _safe_cut(text: str, low: int, high: int) -> int:
    """The last place in ``(low, high]`` where a blank or newline follows a letter, digit or mark; -1: none."""
    while high > low:
        at = max(text.rfind(" ", low, high + 1), text.rfind("\n", low, high + 1))
        if at <= low:
            return -1
        if text[at - 1].isalnum() or text[at - 1] in _MARKS:
            return at
        high = at - 1
    return -1


def leaves(text: str, enc, size: int = LEAF) -> list[tuple[bool, str]]:
    """``(goes on, leaf)``: leaves of ``text`` in order; those that go on belong to the leaf before them.

    Added tokens stand alone. A tokenizer whose added tokens look at the text around them keeps texts whole.
    """
    out: list[tuple[bool, str]] = []
    for part in enc.cut.split(text) if enc.apart and enc.added else [text]:
        at, on = 0, False
        while len(part) - at > size and (enc.apart or not enc.added):
            cut = _safe_cut(part, at, at + size)
            out.append((on, part[at : cut if cut > 0 else at + size]))
            at, on = (cut, False) if cut > 0 else (at + size, True)
        if at < len(part):
            out.append((on, part[at:]))
    return out


def _ids(flat: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int32)))


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``ids`` (array of int): the tokenizer's ids of each whole ``text``.

    One row per row of ``docs``, repeated rows and null ids too. A null or empty
    text has no ids. Ids equal those of the ``tokenizers`` library with no
    special tokens added and its added tokens found in texts.
    """
    path = path or default_path()
    rows = docs.select(F.struct(*keep).alias("_row"), F.col("text").cast("string").alias("_text"))
    row_type = rows.schema["_row"].dataType.simpleString()
    is_long = F.coalesce(F.length("_text") > leaf, F.lit(False))

    def short(batches):
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids, bounds = enc.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _ids(ids, bounds)], ["_row", "ids"])

    def cut(batches):
        enc = encoder(path)
        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                parts = leaves(text, enc, leaf)
                n = len(parts)
                key, row = batch.column(0).slice(i, 1), batch.column(1).slice(i, 1)
                at = pa.array([0] * n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [key.take(at), row.take(at), pa.array(range(n), pa.int32()), pa.array([p[0] for p in parts]),
                     pa.array([p[0] or (k + 1 < n and parts[k + 1][0]) for k, p in enumerate(parts)]), pa.array([p[1] for p in parts], pa.string())],
                    ["key", "_row", "part", "goes_on", "unsplit", "text"])

    def each(batches):
        enc = encoder(path)
        tree = Tree(enc.whole)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                unsplit, texts = part.column(4).to_pylist(), part.column(5).to_pylist()
                ids, bounds = enc.encode([None if u else t for u, t in zip(unsplit, texts, strict=True)])
                found = [tree.leaf(t) if u else Part(t, *[np.empty(0, np.int64)] * 2, ids[bounds[k] : bounds[k + 1]])
                         for k, (u, t) in enumerate(zip(unsplit, texts, strict=True))]
                raw = [[x.tobytes() for x in (p.starts, p.first, p.ids)] for p in found]
                kept = pa.array([t if u else None for u, t in zip(unsplit, texts, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], kept, *(pa.array(list(c), pa.binary()) for c in zip(*raw, strict=True))],
                    ["key", "_row", "part", "goes_on", "text", "starts", "first", "ids"])

    def together(group: pa.Table) -> pa.Table:
        tree = Tree(encoder(path).whole)
        group = group.sort_by("part")
        runs: list[list[Part]] = []
        for on, text, starts, first, ids in zip(*(group.column(c).to_pylist() for c in ("goes_on", "text", "starts", "first", "ids")), strict=True):
            part = Part(text, np.frombuffer(starts, np.int64), np.frombuffer(first, np.int64), np.frombuffer(ids, np.uint32))
            if on:
                runs[-1].append(part)
            else:
                runs.append([part])
        ids = np.concatenate([run[0].ids if len(run) == 1 else tree.whole(run).ids for run in runs])
        return pa.table([group.column("_row").combine_chunks().slice(0, 1), _ids(ids, np.array([0, len(ids)]))], ["_row", "ids"])

    few = rows.where(~is_long).mapInArrow(short, f"_row {row_type}, ids array<int>")
    many = rows.where(is_long).select(F.monotonically_increasing_id().alias("key"), "_row", "_text")
    many = save(many.mapInArrow(cut, f"key long, _row {row_type}, part int, goes_on boolean, unsplit boolean, text string"), "leaves")
    many = many.repartition("key", "part").mapInArrow(
        each, f"key long, _row {row_type}, part int, goes_on boolean, text string, starts binary, first binary, ids binary")
    many = many.groupBy("key").applyInArrow(together, f"_row {row_type}, ids array<int>")
    return few.union(many).select("_row.*", "ids")


_TABLES: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens in a row, and where each id's begin and how many they are.

    A token with a character outside the byte alphabet stands for its own UTF-8 bytes.
    """
    if path not in _TABLES:
        whole, back = encoder(path).whole, {c: b for b, c in byte_alphabet().items()}
        size = max(whole.get_vocab().values(), default=-1) + 1
        names = [whole.id_to_token(i) or "" for i in range(size)]
        raw = [bytes(back[c] for c in n) if all(c in back for c in n) else n.encode() for n in names]
        counts = np.array([len(r) for r in raw], np.int64)
        _TABLES[path] = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(counts) - counts, counts
    return _TABLES[path]


def decode_ids(ids: np.ndarray, bounds: np.ndarray, path: str) -> list[str]:
    """Texts of the ids between neighbouring ``bounds``; bytes that are no UTF-8 become U+FFFD."""
    flat, begin, count = token_bytes(path)
    n = count[ids]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    blob = flat[np.repeat(begin[ids] - ends + n, n) + np.arange(total)].tobytes()
    at = np.concatenate([[0], ends])[bounds].tolist()
    return [blob[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


def _chunks(batch: pa.RecordBatch, column: int, size: int = 2_000_000):
    """(slice of the batch, its ids, their bounds) of about ``size`` ids each; null ids count as none."""
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        values = lists.values.slice(offsets[a], offsets[b] - offsets[a]).to_numpy(zero_copy_only=False)
        yield batch.slice(a, b - a), np.ascontiguousarray(values).view(np.uint32), offsets[a : b + 1] - offsets[a]
        a = b


def decode(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``encoded`` and ``text``: what its ``ids`` stand for, special tokens included. Null ids: an empty text."""
    path = path or default_path()
    rows = encoded.select(F.struct(*keep).alias("_row"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        for batch in batches:
            for part, ids, bounds in _chunks(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(decode_ids(ids, bounds, path), pa.string())], ["_row", "text"])

    return rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, text string").select("_row.*", "text")


def digests(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """``keep``, ``n_tokens``, and SHA-256 of the ids (little-endian, 32 bits) and of the text decoded from them."""
    path = path or default_path()
    rows = encoded.select(F.struct(*keep).alias("_row"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        for batch in batches:
            for part, ids, bounds in _chunks(batch, 1):
                raw = ids.astype("<u4").tobytes()
                of_ids = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)]
                of_text = [hashlib.sha256(t.encode()).hexdigest() for t in decode_ids(ids, bounds, path)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), pa.array(of_ids), pa.array(of_text)],
                                                 ["_row", "n_tokens", "ids_sha256", "decoded_sha256"])

    kinds = f"_row {rows.schema['_row'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, kinds).select("_row.*", "n_tokens", "ids_sha256", "decoded_sha256")
