"""Approximate nearest neighbours by cosine: a forest of hash prefixes.

Each tree is a sorted array of long bit strings, the signs of random projections.
A query descends in all trees at once to the longest prefix it shares with any
string, then all trees ascend together, one bit at a time, and give the
neighbours of each shorter prefix, until there are enough candidates. Their
cosines are taken from the vectors themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import tiles

TREES = 32
BITS = 32
#: Candidates per query, as a share of the rows of a block: vectors without clusters leave little to tell near from far by.
SHARE = 0.5
LEAST = 64


class Forest:
    """Trees over the rows of one block."""

    def __init__(self, unit: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((unit.shape[1], trees * bits))
        self.trees, self.bits = trees, bits
        strings = self.strings(unit)
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=0)

    def strings(self, unit: np.ndarray) -> np.ndarray:
        """Bit strings as numbers, one column per tree; the first bit counts most."""
        signs = (unit @ self.planes > 0).reshape(len(unit), self.trees, self.bits)
        weights = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        return (signs * weights).sum(2, dtype=np.uint64)

    def ranges(self, strings: np.ndarray) -> np.ndarray:
        """For each query, tree and prefix length (0 to ``bits``) where its neighbours begin and end in the sorted array."""
        free = np.arange(self.bits, -1, -1).astype(np.uint64)
        low = strings[:, :, None] >> free << free
        out = np.empty((*low.shape, 2), np.int32)
        high = low + ((np.uint64(1) << free) - np.uint64(1))
        for t in range(self.trees):
            out[:, t, :, 0] = np.searchsorted(self.sorted[:, t], low[:, t], side="left")
            out[:, t, :, 1] = np.searchsorted(self.sorted[:, t], high[:, t], side="right")
        return out

    def candidates(self, ranges: np.ndarray, enough: int) -> np.ndarray:
        """Rows that one query (``ranges`` of it) collects going up."""
        sizes = (ranges[:, :, 1] - ranges[:, :, 0]).sum(0)
        seen = np.zeros(len(self.order), bool)
        # Levels with fewer rows than wanted, even if no two trees gave the same one, are passed over.
        level = int(np.flatnonzero(sizes >= min(enough, sizes[0]))[-1])
        while True:
            for t in range(self.trees):
                a, b = ranges[t, level]
                seen[self.order[a:b, t]] = True
            if level == 0 or np.count_nonzero(seen) >= enough:
                return np.flatnonzero(seen)
            level -= 1


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5, trees: int = TREES, share: float = SHARE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, ties to the smaller id.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; candidates all
    rows but the query's own. Vectors that are null, zero or hold a null or a
    number that is not finite take no part, nor do rows without id. A query
    without candidates has no rows. All rows are in the index.

    The index is made of blocks of bounded size, each with its own forest, so a
    task holds one block of rows and one of queries.
    """
    rows = tiles.vectors(embeddings).where(F.exists("v", lambda x: x != 0))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)

    def run(key, block, asked):
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(block) and len(asked):
            ids, own = block.vec_id.to_numpy(), asked.vec_id.to_numpy()
            by = np.argsort(ids, kind="stable")
            ids, data, query = ids[by], tiles.stack(block.v)[by], tiles.stack(asked.v)
            length, query_length = _lengths(data), _lengths(query)
            unit = data / length[:, None]
            forest = Forest(unit, trees)
            enough = max(LEAST * k, int(share * len(ids)))
            for start in range(0, len(query), 256):
                part = query[start : start + 256] / query_length[start : start + 256, None]
                ranges = forest.ranges(forest.strings(part))
                for i in range(len(part)):
                    at = forest.candidates(ranges[i], enough)
                    at = at[ids[at] != own[start + i]]
                    near = unit[at] @ part[i]
                    if len(near) > k:  # rounding apart, these hold the nearest
                        at = at[near >= np.partition(near, len(near) - k)[len(near) - k] - 1e-9]
                    score = cosine(data[at], length[at], query[start + i], query_length[start + i])
                    first = tiles.top(score, ids[at], k)
                    out["query_id"] += [own[start + i]] * len(first)
                    out["vec_id"] += ids[at][first].tolist()
                    out["score"] += score[first].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = tiles.tiled(rows, queries, run, "query_id long, vec_id long, score double")
    return tiles.best(found, k)


def _lengths(data: np.ndarray) -> np.ndarray:
    """Norms; scaled by the largest component, so that none overflows or vanishes."""
    most = np.abs(data).max(1)
    return most * np.sqrt(((data / most[:, None]) ** 2).sum(1))


def cosine(data: np.ndarray, lengths: np.ndarray, query: np.ndarray, query_length: float) -> np.ndarray:
    """Cosines, row by row in one order of summing, so equal vectors have equal ones."""
    return ((data / lengths[:, None]) * (query / query_length)).sum(1)
