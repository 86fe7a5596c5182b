"""Matching k-mers of two texts at once, with arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from strandweave.functions import dna

_SWAP = dict(zip(map(ord, "ACGTacgt"), map(ord, "TGCAtgca"), strict=True))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _turned(codes: np.ndarray) -> np.ndarray:
    """The reverse complement; letters outside ACGT are kept."""
    out = codes.copy()
    for a, b in _SWAP.items():
        out[codes == a] = b
    return out[::-1]


def window_ids(codes: np.ndarray, k: int) -> np.ndarray:
    """A number for each window of ``k`` letters; equal numbers are equal windows."""
    letters, ids = np.unique(codes, return_inverse=True)
    ids, bits, width = ids.astype(np.int64), max(1, int(len(letters) - 1).bit_length()), 1
    packed = True
    while width < k:
        more = min(width, k - width)
        if packed and bits * (width + 1) <= 62:
            more = min(more, 62 // bits - width)
            ids = (ids[:-more] << (bits * more)) | (ids[more:] & ((1 << (bits * more)) - 1))
        else:
            packed = False
            ids = np.unique(ids, return_inverse=True)[1].astype(np.int64)
            ids = ids[:-more] * (int(ids.max()) + 1) + ids[more:]
        width += more
    return ids


class Matches:
    """Matches of the k-mers of ``first`` in ``second``, by their place in ``first``, forward before reverse."""

    def __init__(self, first: str, second: str, k: int):
        a, b = _codes(first), _codes(second)
        self.n = max(len(a) - k + 1, 0)
        if not self.n or len(b) < k:
            self.n = 0
            return
        ids = window_ids(np.concatenate([a, b, _turned(a)]), k)
        own, there = ids[:self.n], ids[len(a):len(a) + len(b) - k + 1]
        turned = ids[len(a) + len(b):][::-1]
        clean = lambda codes: np.convolve(codes == ord("N"), np.ones(k, np.int64), "valid") == 0
        places = np.flatnonzero(clean(b))
        self.sorted = places[np.argsort(there[places], kind="stable")]
        keys = there[self.sorted]
        self.same = own == turned
        ways = np.stack([own, turned], 1)
        self.low = np.searchsorted(keys, ways, "left")
        self.count = np.searchsorted(keys, ways, "right") - self.low
        self.count[~clean(a)] = 0
        self.count[self.same, 1] = 0

    def totals(self) -> tuple[int, int, int]:
        """How many are forward, reverse and palindromes."""
        if not self.n:
            return 0, 0, 0
        return int(self.count[~self.same, 0].sum()), int(self.count[:, 1].sum()), int(self.count[self.same, 0].sum())

    def rows(self, size: int, cap: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``i, j, match_type`` in order, about ``size`` at a time; the first ``cap`` of them."""
        if not self.n:
            return
        low, count = self.low.ravel(), self.count.ravel()
        some = np.flatnonzero(count)
        low, count = low[some], count[some]
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        total = total if cap is None else min(total, cap)
        for at in range(0, total, size):
            nth = np.arange(at, min(at + size, total))
            way = np.searchsorted(upto, nth, "right")
            j = self.sorted[low[way] + nth - (upto[way] - count[way])]
            i, reverse = some[way] // 2, some[way] % 2 == 1
            kind = np.where(reverse, dna.REVERSE, np.where(self.same[i], dna.PALINDROME, dna.FORWARD))
            yield i.astype(np.int32), j.astype(np.int32), kind.astype(np.int32)
