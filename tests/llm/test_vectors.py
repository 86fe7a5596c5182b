import math
import random

import numpy as np
import pytest

from strandweave.llm import ann, tiles, topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, size string, block string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash", "clash", "clash") for i, v in rows], SCHEMA).repartition(3)


def rows_of(n=400, dims=16, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(8)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.4))) for c in rng.choice(centres)]) for i in range(n)]
    rows += [(400 + i, rows[50][1]) for i in range(60)]  # copies
    rows += [(500, None), (501, []), (502, [None] * dims), (503, [math.nan] * dims), (504, [0.0] * dims), (505, [math.inf] + [0.0] * (dims - 1))]
    rows += [(600, [1.0, 2.0]), (650, [2.0, 1.0]), (None, rows[0][1]), (7, rows[7][1])]  # other lengths, no id, a repeated row
    return rows


def usable(rows):
    seen = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            seen[i, tuple(v)] = v
    return [(i, v) for (i, _), v in seen.items()]


def test_nearest_against_brute_force(spark):
    rows = rows_of()
    got = ann.nearest(table(spark, rows), every=50, share=1.0).collect()
    known = [(i, np.array(v)) for i, v in usable(rows) if any(v)]
    expect = set()
    for q, x in known:
        if q % 50 == 0:
            scored = sorted((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9), i) for i, y in known if i != q and len(y) == len(x))
            expect |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:5], 1)}
    assert {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got} == expect


def test_recall_with_default_share(spark):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((3000, 32)).astype(np.float32)
    got = ann.nearest(table(spark, [(i, v.tolist()) for i, v in enumerate(data)])).collect()
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        score = unit @ unit[q]
        score[q] = -2
        hit += len(set(np.argsort(-score)[:5].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hit / (5 * 60) >= 0.9


def test_trees_descend_and_ascend():
    rng = np.random.default_rng(2)
    unit = rng.standard_normal((300, 8))
    forest = ann.Forest(unit, trees=3, bits=6)
    strings = forest.strings(unit)
    ranges = forest.ranges(strings[:5])
    for q in range(5):
        for t in range(3):
            for level in range(7):
                a, b = ranges[q, t, level]
                expect = {i for i in range(300) if strings[i, t] >> np.uint64(6 - level) == strings[q, t] >> np.uint64(6 - level)}
                assert set(forest.order[a:b, t].tolist()) == expect
        few, all_rows = forest.candidates(ranges[q], 10), forest.candidates(ranges[q], 10_000)
        assert q in few and 10 <= len(few) < 300 and len(all_rows) == 300


@pytest.mark.parametrize("block", [8192, 64])
def test_top_k_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(tiles, "ROWS", block)
    rows = rows_of() + [(1000, [1e30] * 16), (1001, [-1e30] * 16)]
    got = topk.search(table(spark, rows)).collect()
    known = [(i, [math.floor(1024 * x) for x in v]) for i, v in usable(rows)]
    top = (1 << 63) - 1
    expect = set()
    for q, x in known:
        if q % 100 == 0:
            scored = sorted((-max(-top - 1, min(top, sum(a * b for a, b in zip(x, y)))), i) for i, y in known if i != q and len(y) == len(x))
            expect |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:10], 1)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == expect


def test_threshold_stops_early_and_right():
    rng = np.random.default_rng(5)
    data = np.floor(rng.exponential(50, (5000, 4)) ** 1.5)
    lists, ids = topk.Lists(data), rng.permutation(5000)
    for query in (np.array([3.0, 0, 1, 2]), np.array([-1.0, 2, 0, 0]), np.zeros(4)):
        at, score = lists.top(query, ids, 10, own=17)
        full = data @ query
        order = sorted((i for i in range(5000) if ids[i] != 17), key=lambda i: (-full[i], ids[i]))[:10]
        assert at.tolist() == order and score.tolist() == full[order].tolist()


def test_nothing_to_search(spark):
    for rows in ([], [(100, None)], [(100, [1.0, 2.0])]):
        assert ann.nearest(table(spark, rows)).collect() == []
        assert topk.search(table(spark, rows)).collect() == []
