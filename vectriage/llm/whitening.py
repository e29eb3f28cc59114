"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Every entry c becomes the integer floor(256 c) (``grid`` = 256).  The fit list
is each distinct integer vector once: n of them with sums S.

1. Spark sums the products of the fit list exactly (tasks multiply limbs of 20
   bits in doubles, which cannot round, and hand on limbs of 40 bits).  The
   driver then holds the integer scatter C = n sum(x x') - S S' = n^2 V,
   width^2 numbers.
2. The characteristic polynomial of C, residue by residue: for each of enough
   primes below 2^31 a task brings C to Hessenberg form modulo the prime and
   expands the polynomial by its recurrence.  Chinese remaindering on the
   driver gives the exact integer coefficients, width + 1 numbers.
3. All roots are real, so the sign changes of the Taylor shift by t count the
   roots above t exactly (Descartes).  Bisection brackets the largest roots as
   finely as needed to tell neighbours apart; brackets that stay the same are
   one multiple root.
4. Each root's components span the null space of C - root: elimination with
   complete pivoting in long integers, then a step of inverse iteration with
   the same factors, then orthonormal by Gram and Schmidt.
5. Tasks centre (n x - S, exact) and project every row.

Bounds: the driver holds width^2 integers and tasks the primes' copies of them,
whatever the number of rows.  Shuffles carry distinct vectors (partial per
task, so a vector of a third of all rows travels once a task) and limb sums.

Edge cases: rows whose vector is null, empty, or holds a null or non-finite
entry are left out; entries beyond a long after scaling take the nearest long;
a null id stays null; repeated rows give repeated results; vectors of different
widths raise; components without variance are left out (one distinct vector, or
none: an empty result); equal roots take any orthonormal basis; extra columns
are not read.  ``deviation`` is null where it has over 38 digits.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from vectriage.llm.common import keep

LIMB = 40
PRIME_TOP = 1 << 31
#: Fractional bits of the roots, tried in turn until neighbouring roots are apart.
PRECISIONS = (192, 768, 3072)
LONG_TOP = float(1 << 63)


def grid_vectors(batch: pa.RecordBatch, grid: float, width: int | None = None) -> np.ndarray:
    """Integer vectors of the column ``vec`` (finite entries, one width)."""
    flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
    v = np.floor(np.float64(grid) * flat.astype(np.float64))
    top, low = v >= LONG_TOP, v <= -LONG_TOP
    x = np.where(top | low, 0.0, v).astype(np.int64)
    x[top], x[low] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    return x.reshape(batch.num_rows, width or len(flat) // batch.num_rows)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows with a finite vector."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & finite)


def fit_list(rows: DataFrame, grid: float) -> DataFrame:
    """(x): each distinct integer vector once, as little-endian 64-bit integers."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sizes = np.diff(batch.column("vec").offsets.to_numpy())
                if (sizes != sizes[0]).any():
                    raise ValueError("vectors of different widths")
                x = grid_vectors(batch, grid)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary())], names=["x"])

    return rows.select("vec").mapInArrow(run, "x binary").distinct()


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    if len(pc.binary_length(batch.column("x")).unique()) > 1:
        raise ValueError("vectors of different widths")
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i8").reshape(batch.num_rows, -1)


def exact_gram(x: np.ndarray) -> np.ndarray:
    """x'x in Python integers: products of 20-bit limbs, summed in doubles below 2^53."""
    limbs, rest = [], x.copy()
    while True:
        low = rest & ((1 << 20) - 1)
        limbs.append(low.astype(np.float64))
        rest = rest >> 20
        if not (rest + 1 >> 1).any():       # 0 or -1 everywhere: the sign
            limbs.append(rest.astype(np.float64))
            break
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            part = np.zeros_like(out)
            for at in range(0, len(a), 4096):                  # 4096 products of 40 bits stay below 2^53
                part += (a[at:at + 4096].T @ b[at:at + 4096]).astype(np.int64).astype(object)
            out += part << (20 * (i + j))
    return out


def scatter(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """(n, S, n sum(x x') - S S') in exact integers."""
    def run(batches):
        sums, width = None, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                width = x.shape[1]
                ones = np.hstack([x, np.ones((len(x), 1), np.int64)])      # its products are the sums and the count
                part = exact_gram(ones)
                sums = part if sums is None else sums + part
        if sums is not None:
            entry, limb, value = [], [], []
            for i in range(width + 1):
                for j in range(i, width + 1):
                    v, k = int(sums[i, j]), 0
                    sign, v = (-1, -v) if v < 0 else (1, v)
                    while v or not k:
                        entry.append(i * (width + 1) + j)
                        limb.append(k)
                        value.append(sign * (v & ((1 << LIMB) - 1)))
                        v, k = v >> LIMB, k + 1
            yield pa.RecordBatch.from_arrays([pa.array([width] * len(entry), pa.int32()), pa.array(entry, pa.int64()), pa.array(limb, pa.int32()),
                                              pa.array(value, pa.int64())], names=["width", "entry", "limb", "value"])

    parts = fit.mapInArrow(run, "width int, entry long, limb int, value long")
    found = parts.groupBy("width", "entry", "limb").agg(F.sum("value").alias("value")).collect()
    if not found:
        return 0, [], np.zeros((0, 0), object)
    widths = {r["width"] for r in found}
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths: {sorted(widths)}")
    d = widths.pop()
    full = np.zeros((d + 1, d + 1), object)
    for r in found:
        full[divmod(r["entry"], d + 1)] += r["value"] << (LIMB * r["limb"])
    n, s = int(full[d, d]), [int(v) for v in full[:d, d]]
    gram = np.triu(full[:d, :d]) + np.triu(full[:d, :d], 1).T
    return n, s, n * gram - np.outer(np.array(s, object), np.array(s, object))


def _is_prime(n: int) -> bool:
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in (2, 3, 5, 7):                      # enough below 3,215,031,751
        y = pow(a, odd, n)
        if y not in (1, n - 1) and not any((y := y * y % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """Primes from below 2^31 whose product has over ``bits`` bits."""
    out, p, have = [], PRIME_TOP - 1, 0.0
    while have <= bits + 1:
        if _is_prime(p):
            out.append(p)
            have += math.log2(p) - 1e-9
        p -= 2
    return out


def charpoly_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, lowest first, of det(x - a) modulo the prime ``p``, through Hessenberg form."""
    h, d = a.copy(), len(a)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    chain = np.zeros(0, np.int64)               # for every row above: the product of the subdiagonal down to row k
    for k in range(d):
        if k:
            chain = np.append(chain, 1) * h[k, k - 1] % p
        polys[k + 1, 1:] = polys[k, :-1]
        polys[k + 1] = (polys[k + 1] - h[k, k] * polys[k] % p) % p
        if k:
            w = h[:k, k] * chain % p
            polys[k + 1] = (polys[k + 1] - (w[:, None] * polys[:k] % p).sum(0)) % p
    return polys[d]


def charpoly(spark, c: np.ndarray) -> list[int]:
    """Exact coefficients, lowest first, of det(x - c) for a positive semidefinite integer matrix: one residue per prime and task."""
    d = len(c)
    trace = sum(int(c[i, i]) for i in range(d))
    # The coefficients' sizes add up to prod(1 + root) <= (1 + trace / d)^d.
    primes = primes_for(math.ceil(d * (math.log2(1 + trace // d + 1))) + 2)
    flat = [int(v) for v in c.ravel()]

    def run(batches):
        whole = np.array(flat, object).reshape(d, d)
        for batch in batches:
            ps = batch.column("p").to_pylist()
            rows = [charpoly_mod((whole % p).astype(np.int64), p).tolist() for p in ps]
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array(rows, pa.list_(pa.int64()))], names=["p", "residues"])

    todo = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), max(1, spark.sparkContext.defaultParallelism)))
    found = todo.mapInArrow(run, "p long, residues array<long>").collect()
    modulus = math.prod(primes)
    out = [0] * (d + 1)
    for r in found:
        rest = modulus // r["p"]
        unit = rest * pow(rest, -1, r["p"])
        for k, v in enumerate(r["residues"]):
            out[k] += v * unit
    out = [v % modulus for v in out]
    return [v - modulus if v > modulus // 2 else v for v in out]


def roots_above(poly: list[int], num: int, bits: int) -> int:
    """How many roots, with multiplicity, of a polynomial with real roots alone exceed num / 2^bits."""
    d = len(poly) - 1
    c = [v << (bits * (d - k)) for k, v in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += num * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign_at(poly: list[int], num: int, bits: int) -> int:
    value = 0
    for k, v in enumerate(reversed(poly)):
        value = value * num + (v << (bits * k))
    return (value > 0) - (value < 0)


def _brackets(poly: list[int], k: int, bits: int, start: list[tuple[int, int]] | None, start_bits: int) -> list[tuple[int, int]]:
    """For the k largest roots: (low, low + 1) in units of 2^-bits, the root in (low, low + 1].

    Counts halve a bracket until its root is alone there; from then on the sign is enough."""
    top = -poly[-2] + 1                         # the trace is at least every root
    out = []
    for j in range(1, k + 1):
        low, high = (v << (bits - start_bits) for v in start[j - 1]) if start else (0, top << bits)
        if out:
            high = min(high, out[-1][1])
        above_low, above_high = roots_above(poly, low, bits), roots_above(poly, high, bits)
        while high - low > 1:
            mid = (low + high) // 2
            if above_low - above_high == 1:
                above = above_low if _sign_at(poly, mid, bits) == (-1) ** above_low else above_high
            else:
                above = roots_above(poly, mid, bits)
            if above >= j:
                low, above_low = mid, above
            else:
                high, above_high = mid, above
        out.append((low, high))
    return out


def largest_roots(poly: list[int], k: int) -> tuple[list[tuple[int, int]], int]:
    """((low numerator, multiplicity) of each of the k largest positive roots in falling order, fractional bits)."""
    rank = roots_above(poly, 0, 0)
    k = min(k, rank)
    if not k:
        return [], 0
    found, have = None, 0
    for bits in PRECISIONS:
        # A place more than asked for tells the last root from its neighbour.
        found = _brackets(poly, min(k + 1, rank), bits, found, have)
        have = bits
        lows = sorted({low for low, _ in found}, reverse=True)
        gaps = [a - b for a, b in zip(lows, lows[1:])]
        if all(g >> 96 for g in gaps):
            break
    out = []
    for low, high in found[:k]:
        out.append((low, roots_above(poly, low, have) - roots_above(poly, high, have)))
    return out, have


def null_space(c: np.ndarray, num: int, bits: int, dim: int) -> np.ndarray:
    """Orthonormal basis (dim rows of doubles) of the null space of c - num / 2^bits.

    Complete pivoting keeps every factor at most 1; the last ``dim`` pivots are
    those that vanish.
    """
    d = len(c)
    fine = bits + 64
    a = c * (1 << bits)
    for i in range(d):
        a[i, i] -= num
    rows, cols = list(range(d)), list(range(d))
    factors = np.zeros((d, d), object)
    for k in range(d - dim):
        size = np.abs(a[k:, k:])
        i, j = divmod(int(size.argmax()), d - k)
        i, j = i + k, j + k
        if i != k:
            a[[i, k]], factors[[i, k]] = a[[k, i]], factors[[k, i]]
            rows[i], rows[k] = rows[k], rows[i]
        if j != k:
            a[:, [j, k]] = a[:, [k, j]]
            cols[j], cols[k] = cols[k], cols[j]
        if not a[k, k]:
            break
        f = (a[k + 1:, k] << fine) // a[k, k]
        factors[k + 1:, k] = f
        a[k + 1:, k:] -= (f[:, None] * a[k, k:]) >> fine
        a[k + 1:, k] = 0
    m = d - dim

    def back(right: np.ndarray, free: np.ndarray) -> np.ndarray:
        x = np.zeros(d, object)
        x[m:] = free
        for k in range(m - 1, -1, -1):
            x[k] = (right[k] - (a[k, k + 1:] * x[k + 1:]).sum()) // a[k, k] if a[k, k] else 0
        return x

    one = 1 << fine
    zero = np.zeros(d, object)
    basis = [back(zero, np.array([one if i == j else 0 for i in range(dim)], object)) for j in range(dim)]
    # Inverse iteration: the vanished pivots stand for one unit, so the step multiplies what is in the null space and leaves the rest behind.
    better = []
    for x in basis:
        right = np.zeros(d, object)
        placed = np.zeros(d, object)
        placed[cols] = x
        right[:] = placed[rows]
        for k in range(m):
            right[k + 1:] -= (factors[k + 1:, k] * right[k]) >> fine
        grown = right[m:] << bits
        step = back(right, grown)
        scale = max(int(np.abs(step).max()) >> fine, 1)
        better.append(step // scale if any(grown) else x)
    unit = []
    for x in better:
        for u in unit + unit:                   # twice, for what rounding left
            x = x - ((u * ((u * x).sum() >> fine)) >> fine)
        norm = math.isqrt(int((x * x).sum()))
        if norm == 0:
            raise ArithmeticError("null space narrower than the root's multiplicity")
        unit.append((x << fine) // norm)
    out = np.zeros((dim, d))
    for j, u in enumerate(unit):
        v = np.zeros(d, object)
        v[cols] = u
        out[j] = [int(t) / one for t in v]
        out[j] *= 1.0 if out[j][np.abs(out[j]).argmax()] > 0 else -1.0
    return out


def principal(spark, n: int, c: np.ndarray, k: int) -> tuple[np.ndarray, list[float], list[float]]:
    """(unit components, square roots of the roots of c, shares of the trace) of the k largest positive roots."""
    if n < 2 or not any(int(v) for v in np.diag(c)):
        return np.zeros((0, len(c))), [], []
    poly = charpoly(spark, c)
    roots, bits = largest_roots(poly, k)
    parts, seen = [], 0
    while seen < len(roots):
        num, dim = roots[seen]
        # The bracket is (num, num + 1]: its upper end is the root itself when the root is an integer.
        parts.append(null_space(c, num + 1, bits, dim))
        seen += dim
    vectors = np.vstack(parts)[:len(roots)]
    trace = -poly[-2]
    root = [math.isqrt((num + 1) << (bits + 128)) / (1 << (bits + 64)) for num, _ in roots]
    return vectors, root, [float((num + 1) * (1 << 80) // (trace << bits)) / (1 << 80) for num, _ in roots]


def _centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit where it fits, else Python integers."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), 1)
    if n * top + max(map(abs, s)) < 1 << 62:
        return n * x - np.array(s, np.int64)
    return n * x.astype(object) - np.array(s, object)


def _squares(y: np.ndarray) -> pa.Array:
    """Sums of squares of the rows, exact, as decimals."""
    top = max(abs(int(y.max())), abs(int(y.min())))
    if top * top * y.shape[1] < 1 << 62:
        return pa.array((y * y).sum(1).astype(np.int64)).cast(pa.decimal128(38, 0))
    z = y.astype(object)
    return pa.array([Decimal(int(v)) if v < 10 ** 38 else None for v in (z * z).sum(1)], pa.decimal128(38, 0))


def whitened_moments(fit: DataFrame, n: int, s: list[int], vectors: np.ndarray, roots: list[float]) -> np.ndarray:
    """Covariance (divisor n, centred first) of the whitened fit list."""
    k = len(roots)
    project = vectors.T / np.array(roots)

    def sums(mean):
        def run(batches):
            total = np.zeros((k, k))
            for batch in batches:
                if batch.num_rows:
                    w = _centred(_matrix(batch), n, s).astype(np.float64) @ project
                    total += np.diag(w.sum(0)) if mean is None else (w - mean).T @ (w - mean)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["entry", "value"])

        found = fit.mapInArrow(run, "entry long, value double").groupBy("entry").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(k * k)
        for r in found:
            out[r["entry"]] = r["value"] / n
        return out.reshape(k, k)

    return sums(np.diag(sums(None)))


def whiten(vectors: DataFrame, k: int = 4, grid: float = 256.0, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Rows and components 1..k of the usable vectors: (id, component, n, deviation, whitened, explained, identity_error)."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    fit = keep(fit_list(rows, grid))
    n, s, c = scatter(fit)
    components, roots, explained = principal(spark, n, c, k)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not roots:
        return spark.createDataFrame([], schema)
    error = float(np.abs(whitened_moments(fit, n, s, components, roots) - np.eye(len(roots))).max())
    project, m = components.T / np.array(roots), len(roots)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                y = _centred(grid_vectors(batch, grid, len(s)), n, s)
                w = y.astype(np.float64) @ project
                size, at = batch.num_rows * m, np.repeat(np.arange(batch.num_rows), m)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(size, n)),
                     _squares(y).take(pa.array(at)), pa.array(w.ravel()), pa.array(np.tile(explained, batch.num_rows)), pa.array(np.full(size, error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
