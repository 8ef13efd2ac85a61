"""Embedding whitening from the exact characteristic polynomial of the integer scatter matrix.

Spark gathers the exact sums and the polynomial's residues, one prime a row; the driver holds matrices of dimension times
dimension only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchspark.llm.common import append_arrow, staged, table

#: Entries are fixed-point numbers of this many steps a unit.
SCALE = 256
#: Entries must lie below this, so that their fixed-point values are 64-bit integers.
TOP = float(1 << 52)
#: Bits to which roots are isolated, relative to the trace, and of the fixed-point numbers of the inverse iteration.
ROOT_BITS, WORK_BITS = 128, 320
#: Bits of the low limb in which exact sums cross the exchange.
LIMB = 60


@dataclass
class Whitening:
    """What a fit on n distinct vectors gives: exact integer sums, and per component eigenvalue, unit vector and share."""

    n: int
    dim: int
    sums: list[int]
    values: list[float]
    vectors: np.ndarray
    explained: list[float]
    identity_error: float


def usable(vector: str) -> Column:
    """Vectors that are not NULL and hold finite entries within TOP only."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < TOP)
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, entry), F.lit(False))


def fixed(vector: str) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _gram(x: np.ndarray):
    """x' x exactly: in doubles where they hold every sum, else in Python's integers."""
    top = int(np.abs(x).max()) if x.size else 0
    if top * top * len(x) < 1 << 53:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T.dot(y)


def exact_sums(fit: DataFrame, dim: int, block: int = 4096) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, sums of products) of the vectors ``x``; a task gives one row per pair of dimensions, added up by Spark in two limbs."""

    def run(batches):
        n, total, gram = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for b in batches:
            x = _matrix(b.column(0), dim)
            n += len(x)
            total = total + x.astype(object).sum(axis=0) if len(x) else total
            for lo in range(0, len(x), block):
                gram = gram + _gram(x[lo : lo + block])
        if not n:
            return
        cells = [(-1, -1, n)] + [(-1, j, int(v)) for j, v in enumerate(total)] + [(i, j, int(gram[i, j])) for i in range(dim) for j in range(i, dim)]
        i, j, v = zip(*cells)
        limbs = [[Decimal(k >> LIMB) for k in v], [Decimal(k & ((1 << LIMB) - 1)) for k in v]]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(c, pa.decimal128(38, 0)) for c in limbs)], names=["i", "j", "hi", "lo"])

    parts = fit.select("x").mapInArrow(run, "i int, j int, hi decimal(38,0), lo decimal(38,0)")
    n, sums, gram = 0, [0] * dim, np.zeros((dim, dim), object)
    for r in parts.groupBy("i", "j").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect():
        v = (int(r["hi"]) << LIMB) + int(r["lo"])
        if r["j"] < 0:
            n = v
        elif r["i"] < 0:
            sums[r["j"]] = v
        else:
            gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = v
    return n, sums, gram


def primes_below(top: int, count: int) -> list[int]:
    """The largest ``count`` primes below ``top`` (at most 2^32), by strong tests to three bases that settle that range."""

    def prime(m: int) -> bool:
        odd, twos = m - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 7, 61):
            x = pow(base, odd, m)
            if x not in (1, m - 1) and not any((x := x * x % m) == m - 1 for _ in range(twos - 1)):
                return False
        return True

    found, m = [], top - 1 - top % 2
    while len(found) < count:
        if prime(m):
            found.append(m)
        m -= 2
    return found


def polynomial_mod(a: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - a) modulo a prime below 2^31, from the constant up: reduction to Hessenberg form, then its recurrence."""
    h = np.array(a % p, np.int64)
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        at = m + int(below[0])
        h[[m, at]] = h[[at, m]]
        h[:, [m, at]] = h[:, [at, m]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros(d + 1, np.int64)
        new[1:] = polys[k - 1, :-1]
        weight, chain = np.zeros(k, np.int64), 1
        weight[k - 1] = h[k - 1, k - 1]
        for i in range(k - 2, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            weight[i] = int(h[i, k - 1]) * chain % p
        polys[k] = (new - (weight[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[d].tolist()


def characteristic_polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Integer coefficients of det(x - a), constant first, of a symmetric matrix without negative eigenvalues.

    One row of Spark per prime; the coefficients are sums of products of eigenvalues, so C(d, k) (trace / d)^k bounds them and
    with it the number of primes that Chinese remaindering needs.
    """
    d, trace = len(a), int(np.trace(a))
    bits = max(math.log2(math.comb(d, k)) + k * math.log2(max(Fraction(trace, d), 1)) for k in range(d + 1)) + 3
    primes = primes_below(1 << 31, int(bits / 30.9) + 1)
    shared = spark.sparkContext.broadcast(a)

    def run(batches):
        for b in batches:
            for p in b.column("p").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([polynomial_mod(shared.value, p)], pa.list_(pa.int64()))], names=["p", "c"])

    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 64)).mapInArrow(run, "p long, c array<long>").collect()
    whole = math.prod(primes)
    coefficients = [0] * (d + 1)
    for r in sorted(rows, key=lambda r: r["p"]):
        rest = whole // r["p"]
        unit = rest * pow(rest, -1, r["p"])
        coefficients = [(c + unit * v) % whole for c, v in zip(coefficients, r["c"])]
    return [c - whole if 2 * c > whole else c for c in coefficients]


def roots_above(coefficients: list[int], a: int) -> int:
    """How many roots exceed ``a``, each as often as it is one: the sign changes of p(x + a), exact as all roots are real."""
    c = list(reversed(coefficients))
    d = len(c) - 1
    for k in range(d):
        for i in range(1, d + 1 - k):
            c[i] += a * c[i - 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(coefficients: list[int], count: int, trace: int) -> tuple[list[int], int]:
    """(roots, s): the ``count`` largest positive roots in units of 2^-s, each the middle of an interval of at most two units."""
    d = len(coefficients) - 1
    zeros = next(i for i, c in enumerate(coefficients) if c)
    count = min(count, d - zeros)
    s = max(0, ROOT_BITS - trace.bit_length())
    scaled = lambda s: [c << (s * (d - k)) for k, c in enumerate(coefficients)]
    poly = scaled(s)
    while count and roots_above(poly, 1 << 64) < count:  # a root far below the trace gets bits of its own
        s += ROOT_BITS
        poly = scaled(s)
    known = {0: d - zeros, (trace + 1) << s: 0}
    out = []
    for k in range(1, count + 1):
        lo = max(a for a, n in known.items() if n >= k)
        hi = min(a for a, n in known.items() if n < k)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            known[mid] = roots_above(poly, mid)
            lo, hi = (mid, hi) if known[mid] >= k else (lo, mid)
        out.append(2 * lo + 1)
    return out, s + 1


def _unit(z: np.ndarray, one: int) -> np.ndarray:
    return z * one // math.isqrt(sum(int(v) ** 2 for v in z))


def null_vector(a: np.ndarray, root: Fraction, before: list[np.ndarray], steps: int = 4) -> np.ndarray:
    """A unit vector of the null space of a - root, orthogonal to ``before``, as fixed-point integers of WORK_BITS bits.

    Inverse iteration on one elimination with pivots. Vectors of equal roots differ as each is kept orthogonal to the former.
    """
    d, one = len(a), 1 << WORK_BITS
    m = a.astype(object) * one
    shift = root.numerator * one // root.denominator
    for i in range(d):
        m[i, i] -= shift
    scale = max(1, max(abs(int(v)) for v in m.flat) // one)
    m = m // scale
    order, factors = list(range(d)), []
    for k in range(d):
        at = k + max(range(d - k), key=lambda i: abs(m[k + i, k]))
        m[[k, at]] = m[[at, k]]
        if not m[k, k]:
            m[k, k] = 1
        f = m[k + 1 :, k] * one // m[k, k]
        m[k + 1 :, k:] -= f[:, None] * m[k, k:] // one
        order[k] = at
        factors.append(f)
    z = _unit(np.array([one + (i * 7919 + len(before) * 104729) % 1009 * (one // 1009) for i in range(d)], object), one)
    for _ in range(steps):
        for v in before:
            z = z - v * (sum(int(x) * int(y) for x, y in zip(v, z)) // one) // one
        for k in range(d):
            z[[k, order[k]]] = z[[order[k], k]]
            z[k + 1 :] -= factors[k] * z[k] // one
        for k in range(d - 1, -1, -1):
            z[k] = (z[k] - sum((int(x) * int(y) // one for x, y in zip(m[k, k + 1 :], z[k + 1 :])), 0)) * one // m[k, k]
        z = _unit(z, one)
    for v in before:
        z = z - v * (sum(int(x) * int(y) for x, y in zip(v, z)) // one) // one
    return _unit(z, one)


def fit_whitening(docs: DataFrame, vector: str = "embedding", components: int = 4) -> Whitening | None:
    """The whitening of the distinct fixed-point vectors, None if no row has one.

    The scatter n * (sum of x x') - S S' is an integer matrix, exact. Its characteristic polynomial comes from residues, its
    largest roots from sign changes and halving, its unit vectors from inverse iteration in long fixed-point numbers, so nothing
    is rounded before the doubles of the result. Roots of 0 have no component: there may be fewer than asked for.
    ``identity_error`` is taken from the exact covariance and the doubles that scale the rows.
    """
    spark = docs.sparkSession
    good = docs.filter(usable(vector)).select(fixed(vector).alias("x"))
    most = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return None
    dim = most["d"]
    fit = staged(good.filter(F.size("x") == dim).distinct(), "whitening-fit")
    n, sums, gram = exact_sums(fit, dim)
    s = np.array(sums, object)
    scatter = n * gram - s[:, None] * s[None, :]
    unit = math.gcd(*(int(v) for v in scatter.flat)) or 1
    a, trace = scatter // unit, int(np.trace(scatter)) // unit
    if not trace:
        return Whitening(n, dim, sums, [], np.zeros((dim, 0)), [], 0.0)
    found, shift = largest_roots(characteristic_polynomial(spark, a), components, trace)
    roots = [Fraction(r, 1 << shift) for r in found]
    vectors: list[np.ndarray] = []
    for r in roots:
        vectors.append(null_vector(a, r, vectors))
    columns = np.array([[float(Fraction(int(v), 1 << WORK_BITS)) for v in z] for z in vectors]).T
    values = [float(r * unit / (n * n)) for r in roots]
    whole = [[int(v * 2.0**80) for v in z] for z in columns.T]
    error = 0.0
    for i, x in enumerate(whole):
        turned = a.dot(np.array(x, object)) * unit
        for j, y in enumerate(whole):
            covariance = float(Fraction(int(turned.dot(np.array(y, object))), n * n << 160)) / math.sqrt(values[i]) / math.sqrt(values[j])
            error = max(error, abs(covariance - (i == j)))
    return Whitening(n, dim, sums, values, columns, [float(r / trace) for r in roots], error)


def whiten(docs: DataFrame, model: Whitening, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of the rows with a vector of the model's dimension, with ``_deviation`` and ``_whitened`` (one double per component)."""
    n, dim, sums = model.n, model.dim, np.array(model.sums, object)
    axes = model.vectors / (n * np.sqrt(np.array(model.values))) if len(model.values) else model.vectors
    far = max((abs(int(v)) for v in model.sums), default=0)

    def run(column: pa.Array):
        x = np.floor(_matrix(column, dim).astype(np.float64) * SCALE).astype(np.int64)
        top = n * (int(np.abs(x).max()) if x.size else 0) + far
        small = top * top * dim < 1 << 63
        gap = x * n - sums.astype(np.int64) if small else x.astype(object) * n - sums
        square = (gap * gap).sum(axis=1)
        deviation = pa.array(square, pa.int64()) if small else pa.array([v if v < 1 << 63 else None for v in square], pa.int64())
        # column by column: a row's sums do not depend on the rows beside it
        white = np.stack([(gap.astype(np.float64) * axes[:, k]).sum(axis=1) for k in range(axes.shape[1])], axis=1) if axes.shape[1] else np.zeros((len(x), 0))
        ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * axes.shape[1])
        return deviation, pa.ListArray.from_arrays(ends, pa.array(white.ravel()))

    good = docs.filter(usable(vector) & (F.size(vector) == dim))
    return append_arrow(good, [vector], {"_deviation": "bigint", "_whitened": "array<double>"}, run, keep=keep)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every embedding in the first four components.

    Defined results: rows whose vector is NULL, empty or holds NULL, not finite or huge (beyond 2^52) entries take no part, nor
    do those of another length than the most frequent one (ties: the longest); repeated rows are whitened each but fitted
    once; a deviation beyond 64 bits is NULL; components of variance 0 have no rows; a table without vectors gives none.
    """
    docs = table(spark, sf_dir, "embeddings")
    model = fit_whitening(docs)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not model.values:
        return spark.createDataFrame([], schema)
    rows = whiten(docs, model, keep=["vec_id"]).select("vec_id", "_deviation", F.posexplode("_whitened").alias("k", "whitened"))
    explained = F.array(*[F.lit(v) for v in model.explained])
    return rows.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("_deviation").alias("deviation"), "whitened",
        F.get(explained, F.col("k")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
