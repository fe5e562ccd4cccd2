"""Whitening of embeddings by the leading eigenvectors of their covariance.

Vectors become whole numbers x = floor(STEP * c) + OFFSET, so sums over any number of rows are exact. Three passes:

1. exact sums of every dimension;
2. products of the centred vectors, one partial matrix for each task, summed by Spark;
3. projection on the components, which are a matrix of dimensions x components and go to every task.

The eigenvectors come from the d x d matrix alone: Householder reflections make it tridiagonal, bisection over Sturm
counts finds the leading eigenvalues, inverse iteration their vectors, and vectors of close eigenvalues are made
orthogonal again. The driver holds d x d numbers, whatever the number of rows.

Left out are null vectors, vectors with null or non-finite entries, empty ones, entries of 2^42 or more in size, and
vectors whose length is not the most common one (the longer of two equally common ones). Components whose eigenvalue is
below RANK_LIMIT of the trace have no direction and are not returned, so equal vectors or an empty table give no rows.
Repeated ids and null ids stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleargrain.session import stage

STEP, OFFSET = 1024, 100_000
ENTRY_LIMIT = float(1 << 42)
COMPONENTS = 8
RANK_LIMIT = 1e-12
_EPS = np.finfo(float).eps
_ENTRIES = 1 << 20  # entries that are worked on at a time
_LOW = 26  # bits of the lower half of an entry, summed apart

Batches = Iterator[pa.RecordBatch]


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v (array of doubles) of the rows that can be fitted."""
    v = F.col(vector).cast("array<double>")
    wrong = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= ENTRY_LIMIT))
    return rows.select(F.col(vec_id).alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(~wrong)


def _whole(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vector in a batch: the length, rows of the batch, and their whole numbers as a matrix."""
    column = batch.column("v")
    sizes = np.diff(column.offsets.to_numpy())
    for d in np.unique(sizes):
        every = np.flatnonzero(sizes == d)
        for start in range(0, len(every), step := max(1, _ENTRIES // int(d))):
            at = every[start : start + step]
            flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            yield int(d), at, np.floor(STEP * flat.reshape(-1, d)).astype(np.int64) + OFFSET


def _sums(batches: Batches) -> Batches:
    found: dict[int, list] = {}
    for batch in batches:
        for d, at, x in _whole(batch):
            n, s = found.setdefault(d, [0, np.zeros(d, object)])
            high, low = (x >> _LOW).sum(0), (x & ((1 << _LOW) - 1)).sum(0)
            found[d] = [n + len(at), s + high.astype(object) * (1 << _LOW) + low.astype(object)]
    rows = [(d, i, n, str(t)) for d, (n, s) in found.items() for i, t in enumerate(s)]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*rows)] or [()] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.string()))], ["d", "i", "n", "s"])


def exact_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number and sums of the vectors of the most common length; (0, []) when there are none."""
    parts = vectors.select("v").mapInArrow(_sums, "d int, i int, n bigint, s string")
    totals = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    # one row per length; then one row per dimension of one length
    stored = stage(totals, "vector-sums")
    best = stored.filter("i = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return 0, []
    return best.n, [int(r.s) for r in stored.filter(F.col("d") == best.d).orderBy("i").collect()]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the whole part is subtracted in whole numbers, so large offsets cost no digits."""
    middle = np.array([s // n for s in sums], np.int64)
    rest = np.array([float(Fraction(s % n, n)) for s in sums])
    return (x - middle) - rest


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor n; one triangle of sums leaves each task."""
    d = len(sums)
    low = np.tril_indices(d)

    def products(batches: Batches) -> Batches:
        total = np.zeros((d, d))
        for batch in batches:
            for size, _, x in _whole(batch):
                if size == d:
                    y = _centred(x, n, sums)
                    total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(low[0], pa.int32()), pa.array(low[1], pa.int32()), pa.array(total[low])], ["i", "j", "p"])

    parts = vectors.select("v").mapInArrow(products, "i int, j int, p double")
    out = np.zeros((d, d))
    for r in parts.groupBy("i", "j").agg(F.sum("p").alias("p")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.p / n
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and the Householder vectors of a symmetric matrix."""
    a, d, mirrors = a.copy(), len(a), []
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if np.linalg.norm(v[1:]) == 0:
            mirrors.append(None)
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        p = 2 * (a[k + 1 :, k + 1 :] @ v)
        w = p - (p @ v) * v
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1, k] = a[k, k + 1] = -np.copysign(length, a[k + 1, k])
        a[k + 2 :, k] = a[k, k + 2 :] = 0
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, x: float, tiny: float) -> int:
    """Sturm count: how many eigenvalues of the tridiagonal matrix are smaller than x."""
    count, q = 0, 1.0
    for i, a in enumerate(diagonal):
        q = a - x - (off[i - 1] ** 2 / q if i else 0.0)
        if abs(q) < tiny:
            q = -tiny
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> list[float]:
    """The k largest eigenvalues, falling, by bisection."""
    d, around = len(diagonal), np.abs(np.concatenate([[0.0], off, [0.0]]))
    reach = around[:-1] + around[1:]
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    norm = max(abs(low), abs(high), np.finfo(float).tiny)
    tiny = max(_EPS * _EPS * norm, 1e-290)
    out = []
    for j in range(k):
        a, b = low - _EPS * norm * d, high + _EPS * norm * d
        while b - a > 2 * _EPS * max(abs(a), abs(b)) + tiny:
            middle = (a + b) / 2
            if middle in (a, b):
                break
            if below(diagonal, off, middle, tiny) >= d - j:
                b = middle
            else:
                a = middle
        out.append((a + b) / 2)
    return out


def _solver(diagonal: np.ndarray, off: np.ndarray, x: float, tiny: float):
    """Solves (T - x) z = y by elimination with row exchange; a zero pivot counts as ``tiny``."""
    d = len(diagonal)
    u0, u1, u2 = diagonal - x, np.append(off, 0.0), np.zeros(d)
    swapped, factor = np.zeros(max(0, d - 1), bool), np.zeros(max(0, d - 1))
    for i in range(d - 1):
        if abs(off[i]) > abs(u0[i]):
            swapped[i] = True
            row = (off[i], u0[i + 1], u1[i + 1])
            u0[i + 1], u1[i + 1] = u1[i], 0.0
            factor[i] = u0[i] / row[0]
            u0[i], u1[i], u2[i] = row
        else:
            if abs(u0[i]) < tiny:
                u0[i] = tiny
            factor[i] = off[i] / u0[i]
        u0[i + 1] -= factor[i] * u1[i]
        u1[i + 1] -= factor[i] * u2[i]
    if abs(u0[-1]) < tiny:
        u0[-1] = tiny

    def solve(y: np.ndarray) -> np.ndarray:
        z = y.copy()
        for i in range(d - 1):
            if swapped[i]:
                z[i], z[i + 1] = z[i + 1], z[i]
            z[i + 1] -= factor[i] * z[i]
        for i in range(d - 1, -1, -1):
            z[i] = (z[i] - (u1[i] * z[i + 1] if i + 1 < d else 0.0) - (u2[i] * z[i + 2] if i + 2 < d else 0.0)) / u0[i]
        return z

    return solve


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: list[float]) -> np.ndarray:
    """Unit eigenvectors (columns) of the tridiagonal matrix by inverse iteration.

    Eigenvalues closer than a thousandth of the norm are a cluster; each of its vectors is made orthogonal to the others.
    """
    d = len(diagonal)
    norm = float((np.abs(diagonal) + np.append(np.abs(off), 0) + np.append(0, np.abs(off))).max()) or 1.0
    tiny, random = _EPS * norm, np.random.default_rng(1)
    out, cluster, shift = np.zeros((d, len(values))), 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            cluster = j
        shift = min(value, shift - 10 * _EPS * norm)
        solve, z = _solver(diagonal, off, shift, tiny), random.standard_normal(d)
        for _ in range(5):
            z = solve(z / np.abs(z).max())
            z /= np.abs(z).max()
            for _ in range(2):
                z -= out[:, cluster:j] @ (out[:, cluster:j].T @ z)
        out[:, j] = z / np.linalg.norm(z)
    return out


def leading_pairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns.

    The largest entry of each vector is positive, so that results do not depend on the way of computing.
    """
    k = min(k, len(v))
    diagonal, off, mirrors = tridiagonal(v)
    values = leading_values(diagonal, off, k)
    z = leading_vectors(diagonal, off, values)
    for at in range(len(mirrors) - 1, -1, -1):
        if (m := mirrors[at]) is not None:
            z[at + 1 :] -= 2 * np.outer(m, m @ z[at + 1 :])
    z *= np.sign(z[np.abs(z).argmax(0), np.arange(k)])
    return np.array(values), z


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 of each row, exact; null with more than 38 digits."""
    widest = max(max(abs(n * int(hi) - s), abs(n * int(lo) - s)) for hi, lo, s in zip(x.max(0), x.min(0), sums))
    if n * max(int(np.abs(x).max()), 1) < 1 << 62 and widest**2 * len(sums) < 1 << 63:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1)
    return [t if t < 10**38 else None for t in exact]


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector: vec_id, n, deviation (decimal), whitened and explained (arrays by component), identity_error.

    ``rows`` is read three times and should be a stored table.
    """
    vectors = usable(rows, vec_id, vector)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    n, sums = exact_sums(vectors)
    values, basis, trace = np.zeros(0), np.zeros((len(sums), 0)), 0.0
    if n:
        v = covariance(vectors, n, sums)
        trace = float(np.trace(v))
        values, basis = leading_pairs(v, components) if trace > 0 else (values, basis)
    whole = values > RANK_LIMIT * trace
    values, basis = values[whole], basis[:, whole]
    scaled, k, d = basis / np.sqrt(values), int(whole.sum()), len(sums)

    def project(batches: Batches) -> Batches:
        for batch in batches:
            for size, at, x in _whole(batch):
                if size != d:
                    continue
                w = _centred(x, n, sums) @ scaled
                offsets = np.arange(len(at) + 1, dtype=np.int32) * k
                deviation = pa.array(_deviations(x, n, sums), pa.decimal128(38, 0))
                columns = [batch.column("vec_id").take(pa.array(at)), deviation, pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "whitened"])

    out = vectors.mapInArrow(project, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")
    if not k:
        return out.limit(0).select("vec_id", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.array().cast("array<double>").alias("explained"), F.lit(0.0).alias("identity_error"))
    out = stage(out, "whitened")
    explained = F.array(*[F.lit(float(e / trace)) for e in values])
    return out.select("vec_id", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(identity_error(out, k)).alias("identity_error"))


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of the array column ``whitened`` minus the identity."""
    w = F.col("whitened")
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    row = whitened.agg(F.count(F.lit(1)), *[F.sum(w[i]) for i in range(k)], *[F.sum(w[i] * w[j]) for i, j in pairs]).first()
    n, means, products = row[0], [s / row[0] for s in row[1 : k + 1]], row[k + 1 :]
    return max(abs(p / n - means[i] * means[j] - (i == j)) for (i, j), p in zip(pairs, products))


def by_component(whitened: DataFrame) -> DataFrame:
    """The result of ``whiten`` with one row per vector and component, numbered from 1."""
    each = whitened.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened",
        F.col("explained")[F.col("at")].alias("explained"), "identity_error",
    )
