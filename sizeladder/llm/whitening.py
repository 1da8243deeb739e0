"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter.

Entries become integers floor(64 c) (a constant added to all of them changes nothing below). Over the list of distinct
integer vectors, with n vectors y of sum S, tasks add up the exact products, and M = n sum(y y') - S S' is an integer
matrix; the covariance is M / n^2. Then

1. the characteristic polynomial of M is found modulo many 31-bit primes, each by reduction to Hessenberg form, as Spark
   tasks over a table of primes, and put together by Chinese remaindering;
2. its largest roots, all real, are isolated and narrowed on dyadic numbers: by Descartes' rule, which counts exactly
   where all roots are real, and by the sign of the polynomial once a root is alone;
3. components come from inverse iteration towards the null space of M - root I in fixed-point integers of over 300 bits.
   Roots that agree to 100 bits span a common space; their components are made orthogonal to each other;
4. every row is projected in its task.

What reaches the driver is the scatter, at most width^2 integers, and a polynomial of width + 1 coefficients per prime;
the arithmetic is cubic in the width and meant for widths up to a few hundred. The number of rows only counts in steps
that are spread over tasks. All sums are exact, so results do not depend on partitioning.

Rows whose vector is null or has a null or non-finite entry are dropped. Repeated vectors count once in the fit and are
whitened each; null and repeated ids are kept as they are. Components without variance cannot be whitened and are left
out, so that an empty table, a single distinct vector or vectors of no entries give no rows. Vectors of different widths
are an error. Integers beyond 2^62 count as 2^62. A deviation beyond the range of a bigint is null. Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact import integers, limb_rows, matrix, products, total, usable

SCALE, COMPONENTS = 64, 16
#: Bits to which roots are narrowed, bits of a fraction in inverse iteration, and agreement of roots that share a space.
ROOT_BITS, FRACTION_BITS, SAME_BITS = 260, 320, 100
LONGEST = 2 ** 63 - 1


@dataclass(frozen=True)
class Whitening:
    """n, S and the trace of M; per component its root of M and the vector that maps n y - S to the whitened value."""

    n: int
    sums: list[int]
    trace: int
    explained: list[float]
    components: list[list[float]]
    maps: list[list[float]]
    identity_error: float


# --- exact moments -----------------------------------------------------------------------------------------

def scatter(vectors: DataFrame, column: str = "y") -> tuple[int, list[int], np.ndarray]:
    """(n, S, M) of integer vectors, exactly."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            y = matrix(batch.column(column), batch.num_rows).astype(np.int64)
            y = np.hstack([np.ones((len(y), 1), dtype=np.int64), y])
            if held is not None and len(held) != y.shape[1]:
                raise ValueError("vectors differ in width")
            held = products(y, y) if held is None else held + products(y, y)
        if held is not None:
            d = len(held)
            place = [(d - 1, i, j) for i in range(d) for j in range(i, d)]
            rows = limb_rows(place, [int(held[i, j]) for _, i, j in place])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64() if k == 4 else pa.int32()) for k, c in enumerate(zip(*rows))],
                names=["width", "i", "j", "limb", "value"])

    parts = vectors.select(column).mapInArrow(add_up, "width int, i int, j int, limb int, value bigint")
    sums = total(parts, ["width", "i", "j"])  # (width + 1)^2 / 2 integers
    widths = {w for w, _, _ in sums}
    if not widths:
        return 0, [], np.zeros((0, 0), dtype=object)
    if len(widths) > 1:
        raise ValueError("vectors differ in width")
    d = widths.pop()
    n, s = sums[d, 0, 0], [sums[d, 0, j] for j in range(1, d + 1)]
    m = np.zeros((d, d), dtype=object)
    for i in range(d):
        for j in range(i, d):
            m[i, j] = m[j, i] = n * sums[d, i + 1, j + 1] - s[i] * s[j]
    return n, s, m


# --- characteristic polynomial -----------------------------------------------------------------------------

def is_prime(p: int) -> bool:
    """Miller-Rabin with bases that decide every number below 3.2e9."""
    if p < 2 or any(p % q == 0 for q in (2, 3, 5, 7)):
        return p in (2, 3, 5, 7)
    s = ((p - 1) & -(p - 1)).bit_length() - 1
    for base in (2, 3, 5, 7):
        x = pow(base, (p - 1) >> s, p)
        if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(s - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2^31, the largest first, whose product exceeds the bound."""
    out, product, p = [], 1, 2 ** 31 - 1
    while product <= bound:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_modulo(m: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x I - m) modulo p, lowest first, through Hessenberg form."""
    h = (m % p).astype(np.int64)
    d = len(h)
    for k in range(d - 2):
        below = np.nonzero(h[k + 1:, k])[0]
        if not len(below):
            continue
        r = k + 1 + int(below[0])
        if r != k + 1:
            h[[r, k + 1]] = h[[k + 1, r]]
            h[:, [r, k + 1]] = h[:, [k + 1, r]]
        f = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - f[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * f % p).sum(axis=1)) % p
    poly = np.zeros((d + 1, d + 1), dtype=np.int64)  # row k: polynomial of the leading k x k block
    poly[0, 0] = 1
    for k in range(1, d + 1):
        poly[k, 1:] = poly[k - 1, :-1]
        c = np.zeros(k, dtype=np.int64)
        c[k - 1] = h[k - 1, k - 1]
        t = 1
        for i in range(k - 1, 0, -1):
            t = t * int(h[i, i - 1]) % p
            if not t:
                break
            c[i - 1] = int(h[i - 1, k - 1]) * t % p
        poly[k] = (poly[k] - (c[:, None] * poly[:k] % p).sum(axis=0)) % p
    return poly[d].tolist()


def characteristic_polynomial(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Integer coefficients of det(x I - m), lowest first, of a positive semi-definite integer matrix."""
    d, trace = len(m), int(sum(np.diag(m)))
    # the k-th coefficient is a sum over products of k roots: at most C(d, k) (trace / d)^k
    bound = max(comb(d, k) * (-(-trace // d) or 1) ** k for k in range(d + 1))
    primes = primes_beyond(2 * bound + 1)
    tasks = max(1, min(len(primes), 2 * spark.sparkContext.defaultParallelism))

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"p": frame["p"], "c": [polynomial_modulo(m, int(p)) for p in frame["p"]]})

    table = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(tasks)
    found = table.mapInPandas(reduce, "p bigint, c array<bigint>").collect()  # (width + 1) numbers per prime
    product, out = 1, [0] * (d + 1)
    for r in sorted(found, key=lambda r: r["p"]):
        p = r["p"]
        inverse = pow(product % p, -1, p) if product > 1 else 1
        out = [v + product * ((c - v) * inverse % p) for v, c in zip(out, r["c"])]
        product *= p
    return [v - product if 2 * v > product else v for v in out]


# --- real roots --------------------------------------------------------------------------------------------

def roots_above(poly: list[int], a: int, s: int) -> int:
    """Number of roots greater than a / 2^s, with their multiplicity, of a polynomial whose roots are all real.

    The sign changes in the coefficients of the shifted polynomial: for real roots Descartes' rule holds exactly.
    """
    d = len(poly) - 1
    q = [c << (s * (d - k)) for k, c in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            q[k] += a * q[k + 1]
    signs = [c > 0 for c in q if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def sign_at(poly: list[int], a: int, s: int) -> int:
    d, v = len(poly) - 1, 0
    for k in range(d, -1, -1):
        v = v * a + (poly[k] << (s * (d - k)))
    return (v > 0) - (v < 0)


def largest_roots(poly: list[int], most: int, bits: int = ROOT_BITS) -> list[tuple[int, int]]:
    """The largest positive roots as dyadic numbers (a, s) = a / 2^s, falling, correct to `bits` bits."""
    zeros = next(k for k, c in enumerate(poly) if c)
    poly = poly[zeros:]
    wanted = min(most, len(poly) - 1)
    top = max(1, -poly[-2] if len(poly) > 1 else 1).bit_length()
    out: dict[int, tuple[int, int]] = {}
    open_ = [(0, 1 << top, 0, len(poly) - 1, 0)]  # (low, high] / 2^s, roots above low, roots above high
    while open_:
        low, high, s, n_low, n_high = open_.pop()
        if n_low == n_high or n_high >= wanted:
            continue
        if low and high - low <= low >> bits:
            out.update({i: (high, s) for i in range(n_high + 1, n_low + 1)})
            continue
        if high - low < 2:
            low, high, s = 2 * low, 2 * high, s + 1
        mid = (low + high) // 2
        if n_low - n_high == 1:
            sign = sign_at(poly, mid, s)
            if not sign:
                out[n_low] = (mid, s)
                continue
            n_mid = n_low if (sign < 0) == (n_low % 2 == 1) else n_high
        else:
            n_mid = roots_above(poly, mid, s)
        open_ += [(low, mid, s, n_low, n_mid), (mid, high, s, n_mid, n_high)]
    return [out[i] for i in range(1, wanted + 1)]


# --- components --------------------------------------------------------------------------------------------

def _unit(v: np.ndarray, bits: int) -> np.ndarray:
    return np.array([(int(x) << bits) for x in v], dtype=object) // (isqrt(int(v @ v)) or 1)


def _factor(a: np.ndarray, bits: int):
    """Triangular factors with row exchanges in fixed point; a zero pivot counts as one unit of the last place."""
    u, order = a.copy(), list(range(len(a)))
    d = len(u)
    low = np.zeros((d, d), dtype=object)
    for k in range(d):
        r = k + max(range(d - k), key=lambda i: abs(u[k + i, k]))
        if r != k:
            u[[k, r]], low[[k, r]] = u[[r, k]], low[[r, k]]
            order[k], order[r] = order[r], order[k]
        if not u[k, k]:
            u[k, k] = 1
        f = (u[k + 1:, k] << bits) // u[k, k]
        low[k + 1:, k] = f
        u[k + 1:, k:] = u[k + 1:, k:] - ((f[:, None] * u[k, k:]) >> bits)
    return low, u, order


def _solve(factors, b: np.ndarray, bits: int) -> np.ndarray:
    low, u, order = factors
    d = len(b)
    x = b[order].copy()
    for k in range(d):
        x[k + 1:] = x[k + 1:] - ((low[k + 1:, k] * x[k]) >> bits)
    for k in range(d - 1, -1, -1):
        x[k] = (x[k] << bits) // u[k, k]
        x[:k] = x[:k] - ((u[:k, k] * x[k]) >> bits)
    return x


def null_vectors(m: np.ndarray, roots: list[tuple[int, int]]) -> tuple[list[np.ndarray], int]:
    """Unit vectors of m for the given roots in fixed point, and the bits of their fractions."""
    d = len(m)
    size = max(1, int(sum(np.diag(m)))).bit_length()
    bits = size + FRACTION_BITS
    scaled = m * (1 << (bits - size))  # m / 2^size, with `bits` bits of fraction
    out, places = [], []
    for c, (a, s) in enumerate(roots):
        shift = bits - size - s
        root = a << shift if shift >= 0 else a >> -shift
        same = [v for v, r in zip(out, places) if abs(r - root) >> (root.bit_length() - SAME_BITS) == 0]
        shifted = scaled.copy()
        for i in range(d):
            shifted[i, i] -= root
        factors = _factor(shifted, bits)
        v = np.array([((i + 1) * 7919 + (c + 1) * 104729) % 1009 - 504 for i in range(d)], dtype=object)  # any start will do
        for _ in range(4):
            v = _unit(v, bits)
            for _ in range(2):
                for w in same:
                    v = v - ((int(v @ w) >> bits) * w >> bits)
            v = _unit(_solve(factors, _unit(v, bits), bits), bits)
        for w in same:
            v = v - ((int(v @ w) >> bits) * w >> bits)
        v = _unit(v, bits)
        first = max(range(d), key=lambda i: (abs(v[i]), -i))
        out.append(v if v[first] > 0 else -v)
        places.append(root)
    return out, bits


def fit(vectors: DataFrame, column: str = "y", components: int = COMPONENTS) -> Whitening:
    """Components over the distinct integer vectors of a table."""
    n, s, m = scatter(vectors.select(column).distinct(), column)
    trace = int(sum(np.diag(m))) if len(m) else 0
    if not trace:
        return Whitening(n, s, trace, [], [], [], 0.0)
    roots = largest_roots(characteristic_polynomial(vectors.sparkSession, m), components)
    units, bits = null_vectors(m, roots)
    maps = []
    for v, (a, q) in zip(units, roots):
        even = q + q % 2
        deep = 4 * bits  # the root of a / 2^q with many bits
        root = isqrt((a << (even - q)) << deep)  # sqrt(root) * 2^(even / 2 + deep / 2)
        maps.append([(int(x) << (even // 2 + deep // 2)) / (root << bits) for x in v])
    return Whitening(n, s, trace, [a / (trace << q) for a, q in roots],
                     [[int(x) / (1 << bits) for x in v] for v in units], maps, identity_error(m, maps))


def identity_error(m: np.ndarray, maps: list[list[float]]) -> float:
    """Largest absolute entry of the whitened covariance minus the identity, of the maps as they are used."""
    bits = 1100  # every double above 1e-300 is a multiple of 2^-1100

    def whole(x: float) -> int:
        p, q = x.as_integer_ratio()
        return (p << bits) // q

    w = np.array([[whole(x) for x in row] for row in maps], dtype=object)
    off = w @ m @ w.T
    one = 1 << (2 * bits)
    for i in range(len(off)):
        off[i, i] -= one
    return max((abs(int(x)) / one for x in off.ravel()), default=0.0)


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
           components: int = COMPONENTS) -> DataFrame:
    """(`id_col`, component, n, deviation, whitened, explained, identity_error) per usable row and component."""
    vector = F.col(vector_col).cast("array<double>")
    rows = table.where(usable(vector)).select(F.col(id_col).alias("_id"), integers(vector, scale).alias("y"))
    model = fit(rows, "y", components)
    n, sums, k = model.n, model.sums, len(model.maps)
    maps = np.array(model.maps).reshape(k, len(sums))
    widest = max((abs(v) for v in sums), default=0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            y = matrix(batch.column("y"), batch.num_rows).astype(np.int64)
            most = n * int(np.abs(y).max()) + widest
            if most * most * len(sums) < LONGEST:
                off = n * y - np.array(sums, dtype=np.int64)
                deviation = (off * off).sum(axis=1).tolist()
            else:
                off = y.astype(object) * n - np.array(sums, dtype=object)
                deviation = [int(v) if v <= LONGEST else None for v in (off * off).sum(axis=1)]
            white = off.astype(float) @ maps.T
            row = pa.array(np.repeat(np.arange(len(y)), k))
            one = len(y) * k
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                 pa.array(np.full(one, n, dtype=np.int64)), pa.array(deviation, pa.int64()).take(row),
                 pa.array(white.ravel()), pa.array(np.tile(model.explained, len(y))),
                 pa.array(np.full(one, model.identity_error))],
                names=["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(project, f"_id {kind}, component int, n bigint, deviation bigint, whitened double, "
                                   "explained double, identity_error double")
    return out.withColumnRenamed("_id", id_col)
