"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter.

1. Scatter. Entries count as integers y = floor(64 * c); A = n * sum(y y') - sum(y) sum(y)' is n^2 times the covariance,
   an integer matrix, the same for every shift of y. Tasks add their rows' products; sums of exact integers are shuffled.
2. Polynomial. For each of enough 31-bit primes, A is brought to Hessenberg form modulo the prime and its
   characteristic polynomial follows by a recurrence; one prime is one row of a Spark job. Chinese remaindering gives the
   integer coefficients, whose size is bounded by the trace.
3. Roots. All roots are real and not negative. Descartes' rule is exact for such polynomials, so sign changes after a
   Taylor shift count the roots above a point: bisection isolates the roots of the square-free part, and Newton steps on
   integers, certified by a change of sign, refine them to `ROOT_BITS` bits. Multiplicities are counts of the full polynomial.
4. Components. Inverse iteration with A minus the root in high-precision decimals, one component a row of a Spark job;
   a multiple root gives as many orthogonal vectors from different starts.
5. Rows are projected by tasks. Only d x d numbers pass through the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from math import comb, gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.llm.intvectors import floors, is_finite, usual_length, vector_of
from strideline.llm.tokens import batches_of

SHIFT = 1_000_000
BATCH = 4096
ROOT_BITS = 256
DIGITS = 150


# --- scatter ----------------------------------------------------------------------------------------------------


def scatter(vectors: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """Count, sums and sums of products of the integer entries of vectors (e), exactly."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("x", pa.decimal128(38, 0))])
    upper = np.triu_indices(dims)

    def products(batches):
        count, total, square = 0, [0] * dims, [0] * len(upper[0])
        for big in batches:
            for b in batches_of(big, BATCH):
                y = floors(b.column(0), dims)
                if not len(y):
                    continue
                small = int(np.abs(y).max()) ** 2 * len(y) < 1 << 62
                z = y if small else y.astype(object)
                count += len(y)
                total = [a + int(v) for a, v in zip(total, z.sum(axis=0))]
                square = [a + int(v) for a, v in zip(square, (z.T @ z)[upper])]
        if count:
            i = [-1] * (dims + 1) + upper[0].tolist()
            j = [-1, *range(dims), *upper[1].tolist()]
            x = [Decimal(v) for v in [count, *total, *square]]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(x, pa.decimal128(38, 0))], schema=schema)

    rows = vectors.select("e").mapInArrow(products, "i int, j int, x decimal(38,0)").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    at = {(r.i, r.j): int(r.x) for r in rows}
    sums = [at.get((-1, d), 0) for d in range(dims)]
    return at.get((-1, -1), 0), sums, [[at.get((min(i, j), max(i, j)), 0) for j in range(dims)] for i in range(dims)]


# --- characteristic polynomial ----------------------------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every n below 3.3e24."""
    if n < 2:
        return False
    for p in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41):
        if n % p == 0:
            return n == p
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41):
        x = pow(a, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_below(top: int) -> Iterator[int]:
    while True:
        top -= 1
        if is_prime(top):
            yield top


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix with zeros below the first subdiagonal, modulo a prime below 2**31."""
    h, n = a.copy() % p, len(a)
    for k in range(n - 2):
        rows = np.flatnonzero(h[k + 1 :, k])
        if not len(rows):
            continue
        r = k + 1 + int(rows[0])
        if r != k + 1:
            h[[k + 1, r]] = h[[r, k + 1]]
            h[:, [k + 1, r]] = h[:, [r, k + 1]]
        m = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - m[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * m % p).sum(axis=1)) % p
    return h


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - a) modulo p, the constant one first."""
    h, n = hessenberg(a, p), len(a)
    polys = np.zeros((n + 1, n + 1), np.int64)
    polys[0, 0] = 1
    for k in range(n):
        up = np.zeros(n + 1, np.int64)
        up[1:] = polys[k, :-1]
        new, below = (up - h[k, k] * polys[k]) % p, 1
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            new = (new - int(h[i, k]) * below % p * polys[i]) % p
        polys[k + 1] = new
    return polys[n]


def characteristic_polynomial(spark: SparkSession, a: list[list[int]]) -> list[int]:
    """Integer coefficients of det(x - a), the constant one first, of a symmetric matrix without negative eigenvalues.

    Coefficient d - k is at most comb(d, k) * (trace / d)**k in size, which says how many primes are needed."""
    n = len(a)
    trace = sum(a[i][i] for i in range(n))
    bound = max(comb(n, k) * (trace // n + 1) ** k for k in range(n + 1))
    primes, product = [], 1
    for p in primes_below(1 << 31):
        primes.append(p)
        product *= p
        if product > 2 * bound + 1:
            break
    flat = np.array(a, object)

    def residues(batches):
        for b in batches:
            found = [(q, polynomial_mod((flat % q).astype(np.int64), q).tolist()) for q in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["p", "c"])

    rows = _spread(spark, primes).mapInArrow(residues, "p long, c array<long>").collect()
    coefficients = [0] * (n + 1)
    for p, c in ((r.p, r.c) for r in rows):
        rest = product // p
        unit = rest * pow(rest % p, -1, p)
        coefficients = [(x + unit * y) % product for x, y in zip(coefficients, c)]
    return [x - product if 2 * x > product else x for x in coefficients]


def _spread(spark: SparkSession, numbers: list[int]) -> DataFrame:
    """A bounded list of numbers as rows of a few partitions."""
    array = F.array(*[F.lit(x).cast("long") for x in numbers])
    parts = min(len(numbers), spark.sparkContext.defaultParallelism)
    return spark.range(0, len(numbers), 1, parts).select(F.get(array, F.col("id").cast("int")).alias("p"))


# --- roots ------------------------------------------------------------------------------------------------------


def divide(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Quotient and rest by a monic polynomial."""
    rest, q = a[:], [0] * max(len(a) - len(b) + 1, 1)
    for k in range(len(a) - len(b), -1, -1):
        q[k] = rest[k + len(b) - 1]
        if q[k]:
            for i, c in enumerate(b):
                rest[k + i] -= q[k] * c
    return q, rest[: len(b) - 1]


def gcd_mod(a: list[int], b: list[int], p: int) -> list[int]:
    """Monic greatest common divisor modulo p."""

    def trim(x):
        while x and not x[-1]:
            x.pop()
        return x

    a, b = trim([c % p for c in a]), trim([c % p for c in b])
    while b:
        inverse = pow(b[-1], -1, p)
        b = [c * inverse % p for c in b]
        while len(a) >= len(b):
            lead, shift = a[-1], len(a) - len(b)
            for i, c in enumerate(b):
                a[shift + i] = (a[shift + i] - lead * c) % p
            trim(a)
        a, b = b, a
    return a


def square_free(c: list[int]) -> list[int]:
    """The monic polynomial with each root of `c` (monic) once: `c` by its greatest common divisor with its derivative,
    which is put together from divisors modulo primes and proven by exact division."""
    slope = [k * x for k, x in enumerate(c)][1:]
    images: list[list[int]] = []
    product = 1
    for p in primes_below(1 << 31):
        g = gcd_mod(c, slope, p)
        if len(g) == 1:
            return c
        if images and len(g) > len(images[0]):
            continue
        if not images or len(g) < len(images[0]):
            images, product, known = [], 1, [0] * len(g)
        images.append(g)
        unit = product * pow(product % p, -1, p)
        known = [x + unit * ((y - x) % p) for x, y in zip(known, g)]
        product *= p
        known = [x % product for x in known]
        signed = [x - product if 2 * x > product else x for x in known]
        q, rest = divide(c, signed)
        if not any(rest) and not any(divide(slope, signed)[1]):
            return q


def scaled(c: list[int], bits: int) -> list[int]:
    """The monic polynomial whose roots are those of `c` times 2**bits."""
    return [x << (bits * (len(c) - 1 - k)) for k, x in enumerate(c)]


def roots_above(c: list[int], t: int) -> int:
    """Roots above t of a polynomial with real roots only, with multiplicity: sign changes of the shifted coefficients."""
    c = c[:]
    n = len(c)
    for i in range(n - 1):
        for k in range(n - 2, i - 1, -1):
            c[k] += t * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def value(c: list[int], x: int) -> int:
    out = 0
    for k in reversed(c):
        out = out * x + k
    return out


def isolated(c: list[int], top: int, wanted: int) -> list[tuple[int, int]] | None:
    """Intervals (lo, hi] of integers with one root each, of the `wanted` largest roots of a square-free polynomial with
    roots from 0 to top; None if two roots lie within one step."""
    out, todo = [], [(-1, top, len(c) - 1, 0)]
    while todo and len(out) < wanted:
        lo, hi, below, above = todo.pop()
        if below - above == 1:
            out.append((lo, hi))
        elif below > above:
            if hi - lo <= 1:
                return None
            mid = (lo + hi) // 2
            more = roots_above(c, mid)
            todo += [(lo, mid, below, more), (mid, hi, more, above)]
    return out


def refined(c: list[int], lo: int, hi: int) -> int:
    """The least integer not below the only root in (lo, hi], by Newton steps inside a bracket, proven by signs."""
    slope = [k * x for k, x in enumerate(c)][1:]
    rising = value(c, hi) >= 0 and (value(c, lo) < 0 or value(c, hi) > 0)
    beyond = lambda x: (v := value(c, x)) == 0 or (v > 0) == rising  # noqa: E731  not below the root
    x = (lo + hi) // 2
    while hi - lo > 1:
        if beyond(x):
            hi = x
        else:
            lo = x
        s = value(slope, x)
        step = x - value(c, x) // s if s else lo
        # one on either side of the step closes the bracket once it has come near enough
        x = step if lo < step < hi else (lo + hi) // 2
        for y in (step - 1, step + 1):
            if lo < y < hi:
                if beyond(y):
                    hi = y
                else:
                    lo = y
        if not lo < x < hi:
            x = (lo + hi) // 2
    return hi


def largest_roots(c: list[int], wanted: int, bits: int = ROOT_BITS) -> list[tuple[int, int, int]]:
    """`(root times 2**shift rounded up, shift, multiplicity)` of positive roots, falling, until `wanted` are counted with
    multiplicity. `c` is monic with real roots that are not negative."""
    top = -c[-2] + 1
    c = c[next(k for k, x in enumerate(c) if x) :]
    if len(c) == 1:
        return []
    simple = square_free(c)
    while True:
        shift = max(0, bits - top.bit_length())
        s, full = scaled(simple, shift), scaled(c, shift)
        found = isolated(s, top << shift, min(wanted, len(simple) - 1))
        if found is not None:
            break
        bits *= 2
    out, counted = [], 0
    for lo, hi in found:
        many = 1 if len(simple) == len(c) else roots_above(full, lo) - roots_above(full, hi)
        out.append((refined(s, lo, hi), shift, many))
        counted += many
        if counted >= wanted:
            break
    return out


# --- components -------------------------------------------------------------------------------------------------


def null_vectors(a: list[list[int]], root: int, shift: int, many: int, digits: int = DIGITS) -> list[list[float]]:
    """`many` orthogonal unit vectors that a - root / 2**shift takes to nearly nothing, by inverse iteration in decimals."""
    n = len(a)
    with localcontext() as ctx:
        ctx.prec = digits + len(str(max(abs(x) for row in a for x in row)))
        m = np.array([[Decimal(x) for x in row] for row in a], object)
        near = Decimal(root) / Decimal(1 << shift)
        for i in range(n):
            m[i, i] -= near
        order = list(range(n))
        least = abs(near) * Decimal(10) ** -(digits // 2)
        for k in range(n):
            r = k + max(range(n - k), key=lambda i: abs(m[k + i, k]))
            m[[k, r]], order[k], order[r] = m[[r, k]], order[r], order[k]
            if abs(m[k, k]) < least:
                m[k, k] = least
            f = m[k + 1 :, k] / m[k, k]
            m[k + 1 :, k] = f
            m[k + 1 :, k + 1 :] -= np.multiply.outer(f, m[k, k + 1 :])
        found: list[np.ndarray] = []
        seed = 1
        while len(found) < many:
            v = np.array([Decimal((seed * (i + 1) * 7919 + i * i * 104729) % 1009 - 504) for i in range(n)], object)
            seed += 1
            for _ in range(3):
                y = v[order]
                for k in range(n):
                    y[k + 1 :] = y[k + 1 :] - m[k + 1 :, k] * y[k]
                for k in range(n - 1, -1, -1):
                    y[k] = (y[k] - (m[k, k + 1 :] * y[k + 1 :]).sum()) / m[k, k]
                for u in found:
                    y = y - u * (u * y).sum()
                size = (y * y).sum().sqrt()
                v = y / size
            found.append(v)
        return [[float(x) for x in v] for v in found]


def components(spark: SparkSession, a: list[list[int]], wanted: int) -> list[tuple[float, list[float]]]:
    """(eigenvalue, unit eigenvector) of the `wanted` largest positive eigenvalues of an integer scatter, falling."""
    shared = 0
    for row in a:
        for x in row:
            shared = gcd(shared, x)
    if not shared:
        return []
    a = [[x // shared for x in row] for row in a]
    roots = largest_roots(characteristic_polynomial(spark, a), wanted)

    def vectors(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                found = null_vectors(a, *roots[k])
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int64()), pa.array(list(range(len(found))), pa.int64()), pa.array(found, pa.list_(pa.float64()))], names=["k", "at", "v"])

    rows = _spread(spark, list(range(len(roots)))).mapInArrow(vectors, "k long, at long, v array<double>").orderBy("k", "at").collect()
    return [(float(roots[r.k][0] * shared / (1 << roots[r.k][1])), list(r.v)) for r in rows][:wanted]


# --- whitening --------------------------------------------------------------------------------------------------


def whiten(embeddings: DataFrame, wanted: int = 32, name: str = "embedding") -> DataFrame:
    """`vec_id, component, n, deviation, whitened, explained, identity_error` of every finite vector and component.

    Vectors that are NULL, empty, hold NULL, NaN or infinite entries, or have another length than most (the smaller one on
    ties) are dropped. Components with eigenvalue 0 are left out, so one vector, or equal ones, give no rows; equal
    eigenvalues get orthogonal components. NULL and repeated ids stay rows of their own; other columns are ignored. An
    entry beyond 2**52 units of 1/64, or a deviation beyond a long, raises. Without vectors there are no rows.
    """
    spark, empty = embeddings.sparkSession, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dims = usual_length(embeddings, name)
    if not dims:
        return spark.createDataFrame([], empty)
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector_of(name).alias("e")).filter(is_finite(F.col("e")) & (F.size("e") == dims))
    n, sums, square = scatter(kept, dims)
    a = [[n * square[i][j] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    trace = sum(a[i][i] for i in range(dims))
    found = components(spark, a, wanted)
    if not found:
        return spark.createDataFrame([], empty)
    k = len(found)
    # e = eigenvalue / n^2: a projected (n * x - S) / n over sqrt(e) is (n * x - S) times the column
    columns = np.array([v for _, v in found]).T / np.sqrt([e for e, _ in found])
    explained = np.array([e / float(trace) for e, _ in found])

    def centred(y: np.ndarray) -> np.ndarray:
        """n * y - sums, exactly; the shift of the entries falls out."""
        small = n * (int(np.abs(y).max()) + 1) < 1 << 61 and max(map(abs, sums)) < 1 << 61
        return n * y - np.array(sums, np.int64) if small else n * y.astype(object) - np.array(sums, object)

    def outer(batches):
        total, count = np.zeros((k + 1, k)), 0
        for big in batches:
            for b in batches_of(big, BATCH):
                if b.num_rows:
                    w = centred(floors(b.column(0), dims)).astype(np.float64) @ columns
                    total += np.concatenate([w.T @ w, w.sum(axis=0)[None]])
                    count += len(w)
        if count:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "x"])

    sums_of = {(r.i, r.j): r.x for r in kept.select("e").mapInArrow(outer, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()}
    mean = np.array([sums_of[k, j] for j in range(k)]) / n
    covariance = np.array([[sums_of[i, j] for j in range(k)] for i in range(k)]) / n - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(k)).max())
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def rows(batches):
        for big in batches:
            for b in batches_of(big, BATCH // 4):
                if not b.num_rows:
                    continue
                z = centred(floors(b.column(1), dims))
                exact = z if z.dtype == object or int(np.abs(z).max()) ** 2 * dims >= 1 << 62 else None
                far = (z * z).sum(axis=1) if exact is None else (z.astype(object) ** 2).sum(axis=1)
                w = z.astype(np.float64) @ columns
                m = len(w)
                cols = [
                    b.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(np.repeat(far, k).tolist() if far.dtype == object else np.repeat(far, k), pa.int64()), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return kept.mapInArrow(rows, empty)
