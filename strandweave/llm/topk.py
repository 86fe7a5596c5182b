"""Exact top-k by integer inner product: the threshold algorithm over sorted lists.

For each dimension the rows are sorted by their component. A query reads the
lists from the end that its own component favours, some places at a time in all
of them, and scores in full the rows it meets for the first time. No row it has
not met can score more than the components at the places reached would give; it
stops when that bound is below the ``k``-th score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import tiles

SCALE = 1024
STEP = 64
_EXACT = float(1 << 52)
_LONG = (1 << 63) - 1


class Lists:
    """Rows of one block by each dimension, largest component first."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.order = np.argsort(-data, axis=0, kind="stable")

    def top(self, query: np.ndarray, ids: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best rows, ties to the smaller id; the row ``own`` is left out."""
        n, used = len(self.data), np.flatnonzero(query)
        if not len(used):  # all score 0
            at = np.flatnonzero(ids != own)
            score = np.zeros(len(at))
            first = tiles.top(score, ids[at], k)
            return at[first], score[first]
        seen = np.zeros(n, bool)
        at, score = np.empty(0, np.int64), np.empty(0)
        step = STEP
        depth = 0
        down = query[used] < 0  # these lists are read from the other end
        while depth < n:
            last = min(n, depth + step)
            part = np.arange(depth, last)
            places = np.where(down[:, None], n - 1 - part[None, :], part[None, :])
            met = np.zeros(n, bool)
            met[self.order[places, used[:, None]].ravel()] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            new = new[ids[new] != own]
            at = np.concatenate([at, new])
            score = np.concatenate([score, self.data[new] @ query])
            if len(at) > k:
                first = tiles.top(score, ids[at], k)
                at, score = at[first], score[first]
            depth, step = last, step * 2
            edge = self.order[np.where(down, n - last, last - 1), used]
            bound = float((self.data[edge, used] * query[used]).sum())
            # A row not met may equal the bound, and win by a smaller id.
            if len(at) == k and score.min() > bound:
                break
        first = tiles.top(score, ids[at], k)
        return at[first], score[first]


def _large(data: np.ndarray, query: np.ndarray, ids: np.ndarray, k: int, own: int):
    """Numbers that doubles do not hold: whole numbers of any size, scores kept within a long."""
    rows = [[int(x) for x in row] for row in data]
    mine = [int(x) for x in query]
    scores = [max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(row, mine, strict=True)))) for row in rows]
    order = sorted((i for i in range(len(rows)) if ids[i] != own), key=lambda i: (-scores[i], ids[i]))[:k]
    return np.array(order, np.int64), [scores[i] for i in order]


def search(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: exactly the ``k`` highest integer inner products of each query.

    Components count as floor(1024 x). Queries are the rows whose ``vec_id`` is
    divisible by ``every``; candidates all rows but the query's own; ties go to
    the smaller id. Vectors that are null or hold a null or a number that is not
    finite take no part, nor do rows without id. Scores beyond a long are told as
    the nearest long.

    Each block of rows answers each block of queries by itself; the best of all
    blocks follow from their answers.
    """
    rows = tiles.vectors(embeddings)
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)

    def run(key, block, asked):
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(block) and len(asked):
            ids = block.vec_id.to_numpy()
            with np.errstate(over="ignore"):
                data, query = np.floor(tiles.stack(block.v) * SCALE), np.floor(tiles.stack(asked.v) * SCALE)
            big = np.finfo(float).max
            data, query = np.clip(data, -big, big), np.clip(query, -big, big)
            most = np.abs(data).max() * np.abs(query).max(1) * data.shape[1] if len(data) else 0
            lists = Lists(data) if (most < _EXACT).any() else None
            for i, own in enumerate(asked.vec_id.tolist()):
                if most[i] < _EXACT:  # sums of doubles are exact
                    at, score = lists.top(query[i], ids, k, own)
                    score = score.astype(np.int64).tolist()
                else:
                    at, score = _large(data, query[i], ids, k, own)
                out["query_id"] += [own] * len(at)
                out["vec_id"] += ids[at].tolist()
                out["score"] += score
        return pd.DataFrame(out).astype("int64")

    found = tiles.tiled(rows, queries, run, "query_id long, vec_id long, score long")
    return tiles.best(found, k)
