import math
import random
from fractions import Fraction

import numpy as np
import pytest

from strandweave.llm import whiten

SCHEMA = "vec_id long, embedding array<double>, label int, y string, n string, whitened string, _row string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash", "clash", "clash") for i, v in rows], SCHEMA).repartition(3)


def brute(rows):
    """n, sums, covariance (exact) and the integer vector of each row."""
    kept = [(i, [math.floor(64 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(t) for t in {tuple(x) for _, x in kept}]
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n for j in range(d)] for i in range(d)]
    return n, sums, cov, kept, fit


def check(spark, rows, rank=None):
    n, sums, cov, kept, fit = brute(rows)
    d = len(sums)
    values, vectors = np.linalg.eigh(np.array(cov, float))
    values, vectors = values[::-1], vectors[:, ::-1].T
    k = min(16, d) if rank is None else min(16, rank)
    got = whiten.components_of(table(spark, rows)).collect()
    assert len(got) == len(kept) * k
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    trace = sum(cov[i][i] for i in range(d))
    signs = {}
    for i, x in kept:
        assert sorted(by_row[i]) == list(range(1, k + 1))
        centred = np.array([float(a - Fraction(s, n)) for a, s in zip(x, sums, strict=True)])
        for c in range(1, k + 1):
            r = by_row[i][c].pop()
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            assert r.explained == pytest.approx(values[c - 1] / float(trace), rel=1e-9)
            assert r.identity_error < 1e-9
            expect = float(vectors[c - 1] @ centred) / math.sqrt(values[c - 1])
            signs.setdefault(c, []).append((expect, r.whitened))
    for c, pairs in signs.items():
        simple = all(abs(values[c - 1] - values[o]) > 1e-6 * values[0] for o in range(d) if o != c - 1)
        if simple:
            sign = 1 if sum(a * b for a, b in pairs) > 0 else -1
            assert max(abs(a - sign * b) for a, b in pairs) < 1e-6
    return got


def vectors(n, d, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, (rng.standard_normal(d) * np.linspace(1, 3, d)).tolist()) for i in range(n)]


def test_against_numpy(spark):
    rows = vectors(300, 20)
    rows += [(1000 + i, rows[5][1]) for i in range(50)]  # copies count once
    rows += [(2000, None), (2001, []), (2002, [None] * 20), (2003, [math.nan] * 20), (2004, [math.inf] * 20), (None, rows[0][1]), (7, rows[7][1])]
    check(spark, rows)


def test_few_dimensions_and_full_rank(spark):
    for d in (1, 2, 3):
        check(spark, vectors(40, d, d))


def test_equal_and_zero_eigenvalues(spark):
    """A cross has equal eigenvalues; rows on a plane have zero ones, which give no component."""
    cross = [(2 * i + s, [float((j == i) * (1 - 2 * s)) for j in range(6)]) for i in range(6) for s in (0, 1)]
    got = check(spark, cross)
    assert {round(r.explained, 12) for r in got} == {round(1 / 6, 12)}
    rng = random.Random(4)
    plane = [(i, [a := rng.randrange(50) / 64, b := rng.randrange(50) / 64, a + b, a - b, 0.5]) for i in range(60)]
    check(spark, plane, rank=2)


def test_large_components_are_exact(spark):
    rows = [(i, [c * 3e7 for c in v]) for i, v in vectors(50, 4, 9)]
    n, sums, cov, kept, fit = brute(rows)
    model = whiten.fit(table(spark, rows))[4]
    assert (model.n, model.sums) == (n, sums)
    for value, c in zip(model.values, model.components, strict=True):
        m = np.array(cov, float)
        assert np.allclose(m @ c, float(value) * c, rtol=1e-9, atol=1e-9 * float(value))
    got = whiten.components_of(table(spark, rows)).collect()
    exact = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in kept}
    assert all(r.deviation == (exact[r.vec_id] if exact[r.vec_id] < 2**63 else None) for r in got)
    assert any(r.deviation is None for r in got)


def test_lengths_have_a_model_each(spark):
    rows = vectors(30, 3) + [(100 + i, v) for i, v in vectors(20, 2)] + [(500, [1.0] * 7), (501, [1e300, 0.0])]
    got = whiten.components_of(table(spark, rows)).collect()
    assert {r.n for r in got if r.vec_id < 100} == {30} and {r.n for r in got if r.vec_id >= 100} == {20}
    assert not [r for r in got if r.vec_id >= 500]  # one vector has no spread; 1e300 is no long


def test_empty_and_spreadless_tables(spark):
    assert whiten.components_of(table(spark, [])).collect() == []
    assert whiten.components_of(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []


def test_polynomial_modulo_a_prime():
    """Against Fractions, zeros below the diagonal included."""
    rng = random.Random(2)
    for d in (1, 2, 3, 5, 8):
        for zero in (0.0, 0.6):
            m = [[0 if rng.random() < zero else rng.randrange(-50, 50) for _ in range(d)] for _ in range(d)]
            coefficients, work = [1], [[Fraction(0)] * d for _ in range(d)]
            for k in range(1, d + 1):  # Faddeev and Le Verrier
                work = [[sum(m[i][t] * work[t][j] for t in range(d)) + (coefficients[-1] if i == j else 0) for j in range(d)] for i in range(d)]
                coefficients.append(-sum(m[i][t] * work[t][i] for i in range(d) for t in range(d)) / Fraction(k))
            for p in whiten.primes(2):
                assert whiten.polynomial_mod(np.array(m, np.int64), p).tolist() == [int(c) % p for c in reversed(coefficients)]


def test_roots_with_multiplicity():
    def product(roots):
        c = [1]
        for r in roots:
            c = [(c[k - 1] if k else 0) - r * (c[k] if k < len(c) else 0) for k in range(len(c) + 1)]
        return c

    roots = [0, 0, 3, 7, 7, 7, 10**12, 10**12 + 1]
    got = whiten.Roots(product(roots)).largest(16)
    assert got == [(10**12 + 1, 1), (10**12, 1), (7, 3), (3, 1)]
    assert whiten.Roots(product(roots)).largest(3) == got[:3]
    irrational = whiten.Roots([1, -3, 1]).largest(2)
    assert abs(irrational[0][0] ** 2 - 3 * irrational[0][0] + 1) < Fraction(1, 2**380)


def test_limbs_are_exact():
    rng = random.Random(3)
    for top in (5, 2**19, 2**21, 2**45, 2**60):
        y = np.array([[rng.randrange(-top, top) for _ in range(3)] for _ in range(50)], np.int64)
        exact = [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(3)] for i in range(3)]
        limbs = whiten.limb_products(y)
        assert [[sum(int(m[i, j]) << (20 * p) for p, m in limbs.items()) for j in range(3)] for i in range(3)] == exact
