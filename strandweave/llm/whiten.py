"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Components are taken as integers ``floor(scale * c)``, so sums and products over
the fit list are exact: blocks are multiplied in tasks as limbs of 20 bits (no
product of doubles is rounded), Spark adds the limbs, and the driver holds one
matrix of integers, ``M = n * sum(x x') - S S'``, which is n * n times the
covariance. Its characteristic polynomial is found modulo many primes, each by
Hessenberg reduction in a task, and put together by Chinese remaindering. As all
roots are real, the number of roots above a place is the number of sign changes
of the polynomial shifted there; that isolates each root, multiple ones too, and
bisection makes it as sharp as asked for. Eigenvectors come from inverse
iteration on the null space of ``M - root`` in decimal arithmetic.

What reaches the driver depends on the number of dimensions only.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.common import save
from strandweave.llm.tiles import usable

SCALE = 64
COMPONENTS = 16
#: Added to each component so that it is positive; it leaves centred values as they are.
SHIFT = 1_000_000
_LIMB = 20
_BLOCK = 8192
_BITS = 400
_DIGITS = 150


@dataclass
class Model:
    """Whitening of vectors of one length."""

    dims: int
    n: int
    sums: list[int]
    values: list[Fraction] = field(default_factory=list)
    components: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    explained: list[float] = field(default_factory=list)
    identity_error: float = 0.0

    def centred(self, y: np.ndarray) -> np.ndarray:
        """Rows less their mean, which is rounded once."""
        return y - np.array([s / self.n for s in self.sums])

    def whiten(self, y: np.ndarray) -> np.ndarray:
        return self.centred(y.astype(np.float64)) @ (self.components / np.array([[float(_root(v))] for v in self.values])).T

    def deviation(self, y: np.ndarray) -> list[int | None]:
        """Sum of ``(n x - S) ** 2`` of each row; None where it is no long."""
        top = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums), default=0)
        if top < 1 << 62 and self.dims * top * top < 1 << 63:
            d = y * self.n - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        exact = [sum((self.n * int(x) - s) ** 2 for x, s in zip(row, self.sums, strict=True)) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def _root(value: Fraction) -> Decimal:
    with localcontext() as ctx:
        ctx.prec = 60
        return (Decimal(value.numerator) / Decimal(value.denominator)).sqrt()


def integers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * c)`` of each component, computed in double precision."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * scale))


def fitting(vector: Column, scale: int = SCALE) -> Column:
    """Whether a vector takes part: finite components only, whose integers are longs with room to spare."""
    v = vector.cast("array<double>")
    return usable(v) & F.coalesce(F.forall(v, lambda c: F.abs(c) * scale < float(1 << 61)), F.lit(False))


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    offsets = lists.offsets.to_numpy()
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).reshape(-1, dims)


def limb_products(y: np.ndarray) -> dict[int, np.ndarray]:
    """``y' y`` as ``{p: matrix of longs}``, the sum of matrices times ``2 ** (20 p)``; at most ``_BLOCK`` rows."""
    limbs, rest = [], y
    while True:
        low = rest & ((1 << _LIMB) - 1)
        if np.all(np.abs(rest) < 1 << _LIMB):
            limbs.append(rest.astype(np.float64))
            break
        limbs.append(low.astype(np.float64))
        rest = rest >> _LIMB
    out: dict[int, np.ndarray] = {}
    for a, left in enumerate(limbs):
        for b, right in enumerate(limbs):
            part = (left.T @ right).astype(np.int64)
            out[a + b] = out[a + b] + part if a + b in out else part
    return out


def scatter(fit: DataFrame, dims: int) -> list[list[int]]:
    """The sum over ``y`` (array of long) of ``(1, y) (1, y)'``, exact."""

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        seen = 0

        def rows():
            for p, matrix in totals.items():
                i, j = np.nonzero(np.triu(matrix))
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), p, np.int32)),
                                                  pa.array(matrix[i, j])], ["i", "j", "p", "value"])

        for batch in batches:
            y = _matrix(batch.column(0), dims)
            for at in range(0, len(y), _BLOCK):
                part = np.hstack([np.ones((len(y[at : at + _BLOCK]), 1), np.int64), y[at : at + _BLOCK]])
                for p, matrix in limb_products(part).items():
                    totals[p] = totals[p] + matrix if p in totals else matrix
                seen += 1
                if seen % 128 == 0:  # before a long could overflow
                    yield from rows()
                    totals = {}
        yield from rows()

    parts = fit.select("y").mapInArrow(run, "i int, j int, p int, value long")
    sums = parts.groupBy("i", "j", "p").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out = [[0] * (dims + 1) for _ in range(dims + 1)]
    for r in sums.collect():
        out[r.i][r.j] += int(r.value) << (_LIMB * r.p)
    for i in range(dims + 1):
        for j in range(i):
            out[i][j] = out[j][i]
    return out


def primes(count: int) -> list[int]:
    """The largest ``count`` primes below 2 ** 31."""

    def is_prime(n):  # these bases decide all numbers below 2 ** 32
        d, r = n - 1, 0
        while d % 2 == 0:
            d, r = d // 2, r + 1
        for base in (2, 7, 61):
            x = pow(base, d, n)
            if x in (1, n - 1):
                continue
            for _ in range(r - 1):
                x = x * x % n
                if x == n - 1:
                    break
            else:
                return False
        return True

    out, n = [], (1 << 31) - 1
    while len(out) < count:
        if is_prime(n):
            out.append(n)
        n -= 2
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of ``det(t - matrix)`` modulo ``p`` < 2 ** 31, the constant one first.

    The matrix is made upper Hessenberg by similar ones, then the polynomials of
    its leading blocks follow one from another.
    """
    h, n = matrix % p, len(matrix)
    for m in range(1, n - 1):
        found = np.flatnonzero(h[m:, m - 1])
        if not len(found):
            continue
        i = m + int(found[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(1)) % p
    polys = np.zeros((n + 1, n + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, n + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] -= int(h[k - 1, k - 1]) * polys[k - 1] % p
        below, factors = 1, []
        for i in range(k - 2, -1, -1):
            below = below * int(h[i + 1, i]) % p
            factors.append(int(h[i, k - 1]) * below % p)
        if factors:
            polys[k] -= (np.array(factors)[:, None] * polys[k - 2 :: -1][: k - 1] % p).sum(0) % p
        polys[k] %= p
    return polys[n]


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of ``det(t - matrix)``, the constant one first, for a symmetric matrix without negative eigenvalues.

    The absolute coefficient of ``t ** (d - k)`` is at most ``C(d, k) (trace / d) ** k``, which says how many primes are needed.
    """
    d = len(matrix)
    mean = -(-sum(matrix[i][i] for i in range(d)) // d)
    bound = 2 * max(math.comb(d, k) * mean**k for k in range(d + 1)) + 1
    ps = primes(bound.bit_length() // 30 + 1)

    def run(frames):
        for frame in frames:
            for p in frame["p"]:
                residues = np.array([[x % p for x in row] for row in matrix], np.int64)
                yield type(frame)({"p": [p], "c": [polynomial_mod(residues, int(p)).tolist()]})

    tasks = min(len(ps), 2 * spark.sparkContext.defaultParallelism)
    found = spark.createDataFrame([(p,) for p in ps], "p long").repartition(tasks).mapInPandas(run, "p long, c array<long>").collect()
    whole = math.prod(ps)
    out = [0] * (d + 1)
    for row in found:
        rest = whole // row.p
        unit = rest * pow(rest, -1, row.p)
        for k, c in enumerate(row.c):
            out[k] += c * unit
    out = [c % whole for c in out]
    return [c - whole if 2 * c > whole else c for c in out]


class Roots:
    """The largest positive roots of an integer polynomial whose roots are all real and none negative."""

    def __init__(self, coefficients: list[int], bits: int = _BITS):
        d = len(coefficients) - 1
        top = abs(coefficients[d - 1]) if d else 0  # the sum of all roots
        self.shift = max(0, bits - top.bit_length())
        #: Coefficients of the polynomial whose roots are 2 ** shift times as large.
        self.c = [c << self.shift * (d - k) for k, c in enumerate(coefficients)]
        self.counts: dict[int, int] = {}
        self.high = (top << self.shift) + 1

    def above(self, x: int) -> int:
        """How many roots lie above ``x``, multiple ones counted so often: the sign changes of the polynomial shifted by it."""
        if x not in self.counts:
            c = list(self.c)
            n = len(c)
            for i in range(n - 1) if x else ():
                for k in range(n - 2, i - 1, -1):
                    c[k] += x * c[k + 1]
            signs = [v > 0 for v in c if v]
            self.counts[x] = sum(a != b for a, b in zip(signs, signs[1:], strict=False))
        return self.counts[x]

    def _value(self, x: int) -> int:
        out = 0
        for c in reversed(self.c):
            out = out * x + c
        return out

    def largest(self, k: int) -> list[tuple[Fraction, int]]:
        """``(root, multiplicity)`` of the ``k`` largest positive roots, falling; roots that ``bits`` cannot part count as one."""
        out: list[tuple[Fraction, int]] = []
        have, want = 0, min(k, self.above(0))
        self.counts[self.high] = 0
        while have < want:
            low = max(x for x, c in self.counts.items() if c > have)
            high = min(x for x, c in self.counts.items() if c <= have)
            while high - low > 1 and not (self.above(low) == have + 1 and self.above(high) == have):
                mid = (low + high) // 2
                if self.above(mid) > have:
                    low = mid
                else:
                    high = mid
            many = self.above(low) - have
            if high - low > 1:  # one simple root: its sign change is enough
                right = self._value(high)
                sign = (right > 0) - (right < 0)
                while high - low > 1 and sign:
                    mid = (low + high) // 2
                    v = self._value(mid)
                    if v == 0:
                        low, high = mid, mid
                    elif (v > 0) == (sign > 0):
                        high = mid
                    else:
                        low = mid
            out.append((Fraction(high, 1 << self.shift), many))
            have += many
        return out


def null_vectors(matrix: list[list[int]], value: Fraction, many: int, digits: int = _DIGITS) -> list[np.ndarray]:
    """``many`` orthogonal unit vectors of ``matrix - value``'s null space, by inverse iteration; the largest entry is positive."""
    d, rng, found = len(matrix), random.Random(12), []
    with localcontext() as ctx:
        ctx.prec = digits
        root = Decimal(value.numerator) / Decimal(value.denominator)
        a = np.array([[Decimal(x) for x in row] for row in matrix], object).reshape(d, d)
        for i in range(d):
            a[i, i] -= root
        size = max((abs(x) for x in a.flat), default=Decimal(1)) or Decimal(1)
        tiny, order = size.scaleb(-digits), list(range(d))
        for k in range(d):  # LU with row exchanges; a pivot that vanishes is what the null space makes
            best = max(range(k, d), key=lambda i: abs(a[i, k]))
            if best != k:
                a[[k, best]] = a[[best, k]]
                order[k], order[best] = order[best], order[k]
            if not a[k, k]:
                a[k, k] = tiny
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] -= a[k + 1 :, k : k + 1] * a[k : k + 1, k + 1 :]

        def solve(b):
            x = b[order].copy()
            for k in range(d):
                x[k + 1 :] -= a[k + 1 :, k] * x[k]
            for k in range(d - 1, -1, -1):
                x[k] /= a[k, k]
                x[:k] -= a[:k, k] * x[k]
            return x

        def unit(x):
            for other in found:
                x = x - other * (x * other).sum()
            x = x / (x * x).sum().sqrt()
            return x if x[max(range(d), key=lambda i: abs(x[i]))] > 0 else -x

        for _ in range(many):
            x = unit(np.array([Decimal(rng.randrange(1, 1 << 30)) for _ in range(d)], object))
            for _ in range(50):
                before, x = x, unit(solve(x))
                if many > 1:  # the rest of the null space may turn in each step
                    x = unit(x)
                if max(abs(u - v) for u, v in zip(before, x, strict=True)) < Decimal(10) ** -40:
                    break
            found.append(x)
        return [np.array([float(v) for v in x]) for x in found]


def fit(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE, column: str = "embedding") -> dict[int, Model]:
    """One model per length of vectors, from each different vector of integers once.

    ``components`` are the eigenvectors of the largest eigenvalues; those whose
    eigenvalue is zero do not exist, as they cannot be scaled to one. Vectors
    that are null, empty, hold null or non-finite components or components
    beyond 2 ** 55 take no part; no vectors give no model.
    """
    spark = embeddings.sparkSession
    vector = F.col(column)
    lists = save(embeddings.where(fitting(vector, scale)).select(integers(vector, scale).alias("y")).distinct(), "fit")
    models = {}
    for dims in sorted(r.d for r in lists.select(F.size("y").alias("d")).distinct().collect()):
        mine = lists.where(F.size("y") == dims)
        g = scatter(mine, dims)
        n, sums = g[0][0], g[0][1:]
        m = [[n * g[i + 1][j + 1] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
        model = models[dims] = Model(dims, n, sums, components=np.empty((0, dims)))
        trace = sum(m[i][i] for i in range(dims))
        if not trace:
            continue
        vectors, values = [], []
        for value, many in Roots(polynomial(spark, m)).largest(components):
            vectors += null_vectors(m, value, many)
            values += [value / (n * n)] * many
        model.values, model.components = values[:components], np.array(vectors[:components])
        model.explained = [float(v * n * n / trace) for v in model.values]
        model.identity_error = identity_error(mine, model)
    return models


def identity_error(fit_list: DataFrame, model: Model) -> float:
    """The largest entry of the whitened fit list's covariance less the identity; rows are centred before they are multiplied."""

    def run(batches):
        k = len(model.values)
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = model.whiten(_matrix(batch.column(0), model.dims))
            w = np.hstack([np.ones((len(w), 1)), w])
            total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "value"])

    sums = fit_list.select("y").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros((len(model.values) + 1,) * 2)
    for r in sums.collect():
        out[r.i, r.j] = r.value
    mean = out[0, 1:] / model.n
    cov = out[1:, 1:] / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(len(mean))).max(initial=0.0))


def transform(embeddings: DataFrame, models: dict[int, Model], keep: tuple[str, ...] = ("vec_id",), scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """``keep``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` of each row that takes part.

    ``whitened`` and ``explained`` are arrays, one entry per component. Repeated
    rows and null ids each keep their row. ``deviation`` is null where the exact
    number is no long. Rows whose length has no model are left out.
    """
    vector = F.col(column)
    rows = embeddings.where(fitting(vector, scale)).select(F.struct(*keep).alias("_row"), integers(vector, scale).alias("_y"))

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            for dims in set(sizes.tolist()) & set(models):
                model, at = models[dims], pa.array(np.flatnonzero(sizes == dims))
                y = _matrix(lists.take(at), dims)
                w = model.whiten(y) if model.values else np.empty((len(y), 0))
                k, n = w.shape[1], len(y)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array(np.full(n, model.n)), pa.array(model.deviation(y), pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(w.ravel())), pa.ListArray.from_arrays(offsets, pa.array(np.tile(model.explained, n))),
                     pa.array(np.full(n, model.identity_error))],
                    ["_row", "n", "deviation", "whitened", "explained", "identity_error"])

    kinds = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    return rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, {kinds}").select(
        "_row.*", "n", "deviation", "whitened", "explained", "identity_error")


def components_of(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per row that takes part and component, numbered from 1: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    rows = transform(embeddings, fit(embeddings, components))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("_at", "_c")
    return rows.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("_at") + 1).alias("component"), "n", "deviation", "_c.whitened", "_c.explained", "identity_error")
