"""Whitening of embeddings: an exact distributed covariance, float32 eigenvectors, and their refinement in higher precision.

Fit.  Vectors become whole numbers, and each distinct one counts once.  Tasks centre them at the whole number next to the mean,
before they multiply, and add up products in float64 matrix products of 20-bit slices, none of which rounds; one sum for each
pair of dimensions comes out, so the covariance is an exact fraction at any size.

Eigenvectors.  The driver holds one matrix of dimension x dimension.  LAPACK gives its eigenvectors in float32; the iteration of
Ogita and Aishima then corrects them with matrix products alone, doubling the right digits each time.  Its products run in fixed
point of BITS bits, again by slices that float64 multiplies without rounding.  Eigenvalues nearer to each other
than the iteration can tell are a cluster: the matrix is projected on the cluster's vectors, shifted by its mean, scaled up, and
solved in the same way (float32, iteration, clusters inside), and the vectors are turned by that.  What agrees to SAME of the spread is
one eigenvalue, whose vectors are any basis.

Edge cases: vectors that are null, or hold a null or a number that is not finite, are left out; rows without vec_id stay; shorter vectors
count as padded with zeros; entries beyond 2^61 count as 2^61; repeated vectors and repeated rows count once in the fit, and each
row is returned; a component without variance has a null ``whitened`` and takes no part in identity_error, which is null if no
component has any, as ``explained`` is without any variance; ``deviation`` is null where it does not fit a long; there are as many components as dimensions, at
most ``k``; an empty table, or vectors of no entries, give no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

K, SCALE, LARGEST = 4, 256, 2**61
#: Fixed-point bits, bits of a slice, and rows whose slice products float64 adds up without rounding.
BITS, SLICE, ROWS = 120, 20, 4096
#: Gap of eigenvalues, in parts of the spread, below which they are one; correction at which the iteration is at its end.
SAME, DONE = 2.0**-58, 2.0**-56
ROUNDS = 40
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- exact products -------------------------------------------------------------------------------------------------


def slices(x: np.ndarray, width: int = SLICE) -> list[np.ndarray]:
    """float64 arrays whose sum, the k-th times 2 ** (width * k), is x (int64 or Python integers)."""
    size, sign = np.abs(x), np.where(x < 0, -1.0, 1.0)
    out = []
    while not out or (size != 0).any():
        out.append((size & (2**width - 1)).astype(float) * sign)
        size = size >> width
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of arrays of Python integers, exact, by float64 matrix products."""
    width = (53 - a.shape[1].bit_length()) // 2
    sums: dict[int, np.ndarray] = {}
    for (i, x), (j, y) in itertools.product(enumerate(slices(a, width)), enumerate(slices(b, width))):
        sums[i + j] = sums.get(i + j, 0) + (x @ y).astype(np.int64)
    return sum((s.astype(object) << (width * k) for k, s in sums.items()), np.zeros((a.shape[0], b.shape[1]), object))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product in fixed point."""
    return (product(a, b) + (1 << (BITS - 1))) >> BITS


def floats(x: np.ndarray) -> np.ndarray:
    """Fixed point, each number correctly rounded to float64."""
    return (x / 2**BITS).astype(float)


def one(n: int) -> np.ndarray:
    out = np.full((n, n), 0, object)
    out[np.arange(n), np.arange(n)] = 1 << BITS
    return out


# --- eigenvectors ---------------------------------------------------------------------------------------------------


def corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One step of the iteration: (x, eigenvalues, largest correction, gap that it can tell)."""
    n = len(a)
    r, s = one(n) - times(x.T, x), times(x.T, times(a, x))
    values = (np.diag(s) << BITS) // ((1 << BITS) - np.diag(r))
    off = s.copy()
    off[np.arange(n), np.arange(n)] -= values
    gap = max(SAME, 2 * (np.linalg.norm(floats(off)) + np.linalg.norm(floats(a)) * np.linalg.norm(floats(r))))
    apart = values[None, :] - values[:, None]
    told = np.abs(floats(apart)) > gap
    e = np.where(told, ((s << BITS) + values[None, :] * r) // np.where(told, apart, 1), r >> 1)
    return x + times(x, e), values, float(np.abs(floats(e)).max()), gap


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors in columns) of a symmetric matrix in fixed point, by falling value."""
    n = len(a)
    mean = sum(np.diag(a)) // n
    shifted = a.copy()
    shifted[np.arange(n), np.arange(n)] -= mean
    largest = max(abs(v) for v in shifted.flat)
    if n == 1 or not largest:
        return np.diag(a), one(n)
    up = BITS - largest.bit_length()  # scaled to entries of about one
    b = shifted << up if up >= 0 else shifted >> -up
    x = np.linalg.eigh(floats(b).astype(np.float32))[1]
    x = (x.astype(np.float64) * 2.0**60).astype(np.int64).astype(object) << (BITS - 60)
    for _ in range(ROUNDS):
        x, values, change, gap = corrected(b, x)
        order = sorted(range(n), key=lambda i: -values[i])
        x, values = x[:, order], values[order]
        if change <= DONE:
            break
        x = settled(b, x, floats(values), gap)
    return (values >> up if up >= 0 else values << -up) + mean, x


def settled(b: np.ndarray, x: np.ndarray, values: np.ndarray, gap: float) -> np.ndarray:
    """x with the vectors of each cluster of values turned to be eigenvectors inside it."""
    x, n, start = x.copy(), len(values), 0
    for end in range(1, n + 1):
        if end < n and values[end - 1] - values[end] <= gap:
            continue
        if 1 < end - start < n:
            own = x[:, start:end]
            own = own + (times(own, one(end - start) - times(own.T, own)) >> 1)  # towards orthogonal
            inside = times(own.T, times(b, own))
            inside = (inside + inside.T) >> 1
            if values[start] - values[end - 1] > SAME or np.abs(floats(inside) - np.diag(np.diag(floats(inside)))).max() > SAME:
                own = times(own, eigen(inside)[1])
            x[:, start:end] = own
        start = end
    return x


# --- distributed sums -----------------------------------------------------------------------------------------------


def matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def sums(fit: DataFrame, centre: list[int], squares: bool) -> dict[tuple[int, int], int]:
    """(i, -1) -> sum of entry i less its centre; with ``squares`` also (i, j), i <= j -> sum of the products.  Exact.

    Tasks send one number for each pair of dimensions and slice pair; the sums, of which there are as many, go to the driver."""
    middle = np.array(centre, np.int64)

    def run(batches):
        held: dict[tuple[int, bool], np.ndarray] = {}
        upper = np.triu_indices(len(middle))

        def rows():
            for (shift, square), total in held.items():
                i, j = upper if square else (np.arange(len(middle)), np.full(len(middle), -1))
                v = total[upper] if square else total
                some = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array(c[some], t) for c, t in ((i, pa.int32()), (j, pa.int32()), (np.full(len(v), shift), pa.int32()), (v, pa.int64()))], names=["i", "j", "shift", "v"])

        count = 0
        for b in batches:
            y = matrix(b.column(0)) - middle
            for at in range(0, len(y), ROWS):
                parts = slices(y[at : at + ROWS])
                for p, x in enumerate(parts):
                    held[SLICE * p, False] = held.get((SLICE * p, False), 0) + x.sum(axis=0).astype(np.int64)
                    for q, z in enumerate(parts if squares else ()):
                        held[SLICE * (p + q), True] = held.get((SLICE * (p + q), True), 0) + (x.T @ z).astype(np.int64)
                count += 1
                if count % 256 == 0:  # long before int64 is full
                    yield from rows()
                    held.clear()
        yield from rows()

    parts = fit.select("x").mapInArrow(run, "i int, j int, shift int, v long")
    out: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("i", "j", "shift").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        out[r.i, r.j] = out.get((r.i, r.j), 0) + (int(r.v) << r.shift)
    return out


class Whitening(NamedTuple):
    """n distinct vectors; ``centre`` and ``rest``: n * x - sums = n * (x - centre) - rest; components in columns, by falling value."""

    n: int
    centre: list[int]
    rest: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def whole(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that take part, and the dimension."""
    wrong = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    used = vectors.where(F.col("embedding").isNotNull()).where(~wrong)
    entry = lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(LARGEST)), F.lit(-LARGEST))
    used = used.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", entry).alias("x"))
    least, most = used.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != most:
        used = used.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("x"))))
    return used, most or 0


def fitted(distinct: DataFrame, width: int, k: int = K) -> Whitening:
    """The first k components of distinct vectors (x)."""
    n = distinct.count()
    first = sums(distinct, [0] * width, squares=False)
    centre = [(2 * first.get((i, -1), 0) + n) // (2 * n) for i in range(width)]
    s = sums(distinct, centre, squares=True)
    rest = np.array([s.get((i, -1), 0) for i in range(width)] + [0], object)[:-1]
    square = np.array([[s.get((min(i, j), max(i, j)), 0) for j in range(width)] + [0] for i in range(width)], object)[:, :-1]
    exact = n * square - rest[:, None] * rest[None, :]  # the covariance times n * n
    largest = max(max(abs(v) for v in exact.flat), 1)
    values, vectors = eigen((exact << BITS) // largest)
    unit = largest / n**2
    values = np.array([v if v > (width << BITS) // 2**80 else 0 for v in values], object)
    vectors = floats(vectors[:, :k])
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Whitening(n, centre, rest.tolist(), vectors, floats(values[:k]) * unit, sum(np.diag(exact)) / n**2)


def projected(rows: DataFrame, model: Whitening) -> DataFrame:
    """rows (vec_id, x) as (vec_id, deviation, w): w holds the whitened entries, null where a component has no variance."""
    centre, rest, n = np.array(model.centre, np.int64), np.array([*model.rest, 0], object)[:-1], model.n
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = np.where(model.values > 0, model.vectors / np.sqrt(model.values), np.nan)

    def run(batches):
        for b in batches:
            y = matrix(b.column(1)) - centre
            most = n * int(np.abs(y).max(initial=0)) + max(map(abs, model.rest), default=0)
            exact = n * (y if most**2 * len(centre) < 2**63 else y.astype(object)) - (rest.astype(np.int64) if most**2 * len(centre) < 2**63 else rest)
            deviation = [d if d < 2**63 else None for d in (exact * exact).sum(axis=1).tolist()]
            w = (exact / n).astype(float) @ turn
            w = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], pa.array(w.ravel(), mask=np.isnan(w.ravel())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation, pa.int64()), w], names=["vec_id", "deviation", "w"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, w array<double>")


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the whitened vectors' covariance less the identity."""
    some = [i for i, v in enumerate(model.values) if v > 0]
    pairs = [(i, j) for i in some for j in some if i <= j]
    if not pairs:
        return None
    w = projected(distinct.withColumn("vec_id", F.lit(0).cast("long")), model)
    # centred before multiplying, in the aggregate
    found = w.agg(*(F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))


def whiten(vectors: DataFrame, k: int = K) -> DataFrame:
    """SCHEMA: each row of vectors (vec_id, embedding) on each component."""
    rows, width = whole(vectors)
    if not width:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    distinct = save(rows.select("x").distinct(), "distinct")
    model = fitted(distinct, width, k)
    error = F.lit(identity_error(distinct, model)).cast("double")
    share = F.array(*(F.lit(float(v) / model.trace if model.trace else None).cast("double") for v in model.values))
    out = projected(rows, model).select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), error.alias("identity_error"))
