"""Whitening against fractions, and the eigenvector iteration on clusters."""

import math
from fractions import Fraction

import numpy as np
import pytest

from quoteloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, x string, w string"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, "x", "w") for i, v in rows], SCHEMA).repartition(parts)


def rotated(n, values, seed=0):
    """(matrix, vectors) in fixed point with these eigenvalues."""
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0]
    x = (q * 2.0**60).astype(np.int64).astype(object) << (W.BITS - 60)
    for _ in range(4):
        x = x + (W.times(x, W.one(n) - W.times(x.T, x)) >> 1)
    scaled = np.array([int(v * 2**80) << (W.BITS - 80) for v in values], object)
    a = W.times((x * scaled[None, :]) >> W.BITS, x.T.copy())
    return (a + a.T) >> 1, x


SPREAD = np.random.default_rng(1).uniform(0.1, 1, 24)
CLUSTERED = {
    "apart": SPREAD,
    "near": np.concatenate([0.5 + np.arange(8) * 1e-9, 0.7 + np.arange(8) * 1e-13, SPREAD[:8]]),
    "nested": np.concatenate([0.5 + np.array([0, 3, 5]) * 1e-5, 0.5 + 2e-5 + np.arange(4) * 1e-12, SPREAD[:5]]),
    "falling": 2.0 ** -np.arange(20),
}


@pytest.mark.parametrize("kind", CLUSTERED)
def test_eigenvectors_to_double_precision(kind):
    values = CLUSTERED[kind]
    a, x = rotated(len(values), values)
    got, found = W.eigen(a)
    order = np.argsort(-values, kind="stable")
    assert np.abs(W.floats(got) - values[order]).max() < 1e-16
    dots = W.floats(W.times(x[:, order].T, found))
    assert np.abs(np.abs(np.diag(dots)) - 1).max() < 1e-15
    assert np.abs(dots - np.diag(np.diag(dots))).max() < 1e-14


def test_float32_alone_cannot_tell_them():
    a, x = rotated(24, CLUSTERED["near"])
    plain = np.linalg.eigh(W.floats(a).astype(np.float32))[1]
    dots = np.abs(W.floats(x).T @ plain)
    assert (dots.max(axis=0) < 0.99).any()


@pytest.mark.parametrize("n", [1, 2, 12])
def test_equal_eigenvalues_have_some_basis(n):
    a, _ = rotated(n, [0.5] * (n // 2) + [0.25] * (n - n // 2))
    values, x = W.eigen(a)
    assert np.abs(W.floats(W.one(n) - W.times(x.T, x))).max() < 1e-30
    assert np.abs(W.floats(W.times(a, x) - ((x * values[None, :]) >> W.BITS))).max() < 1e-17


def test_products_are_exact():
    r = np.random.default_rng(2)
    a, b = ([[int(v) ** 3 for v in row] for row in r.integers(-(2**40), 2**40, (5, 5))] for _ in range(2))
    a, b = np.array(a, object), np.array(b, object)
    assert (W.product(a, b) == a.dot(b)).all()


def brute(rows):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(x) for _, x in kept)
    kept = [(i, x + [0] * (width - len(x))) for i, x in kept]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = [[float(sum((Fraction(x[i]) - Fraction(s[i], n)) * (Fraction(x[j]) - Fraction(s[j], n)) for x in fit) / n) for j in range(width)] for i in range(width)]
    values, q = np.linalg.eigh(np.array(cov))
    out = {}
    for i, x in kept:
        deviation = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        centred = np.array([float(Fraction(a) - Fraction(b, n)) for a, b in zip(x, s, strict=True)])
        for k in range(min(4, width)):
            e = values[-1 - k]
            out[i, k + 1] = (n, deviation, abs(float(centred @ q[:, -1 - k])) / math.sqrt(e), e / sum(values))
    return out


def test_whitening_equals_fractions(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(c) for c in r.normal(size=6) * [3, 1, 2, 0.5, 0.1, 1] + 2]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(200, None), (201, [1.0, None, 2.0]), (202, [math.nan] * 6), (203, [math.inf, 1.0]), (204, [-0.0, 1.0]), (205, [])]
    got = W.whiten(vectors(spark, rows)).collect()
    want = brute(rows)
    assert {(g.vec_id, g.component) for g in got} == set(want) and len(got) == len(want)
    for g in got:
        n, deviation, size, share = want[g.vec_id, g.component]
        assert (g.n, g.deviation) == (n, deviation)
        assert math.isclose(abs(g.whitened), size, rel_tol=1e-9, abs_tol=1e-11) and math.isclose(g.explained, share, rel_tol=1e-12)
        assert g.identity_error < 1e-12
    signs = {g.vec_id: g.whitened for g in got if g.component == 1}
    assert len({signs[0] == signs[100 + i] for i in range(30)}) == 1


def test_sums_are_exact_for_large_entries(spark):
    rows = [(1, [3e15, 1.0]), (2, [-2.5e15, 2.0]), (3, [1e9, 1e30])]
    got = {(g.vec_id, g.component): g for g in W.whiten(vectors(spark, rows)).collect()}
    assert got[1, 1].n == 3 and got[1, 1].deviation is None and got[1, 1].identity_error < 1e-12
    assert W.whole(vectors(spark, rows))[0].where("vec_id = 3").first().x[1] == W.LARGEST


def test_defined_results_of_odd_tables(spark):
    assert W.whiten(vectors(spark, [(1, [1.0])]).limit(0)).collect() == []
    assert W.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    (got,) = W.whiten(vectors(spark, [(None, [0.5])])).collect()
    assert tuple(got) == (None, 1, 1, 0, None, None, None)
    flat = sorted(W.whiten(vectors(spark, [(1, [1.0, 5.0]), (1, [2.0, 5.0]), (2, [1.0, 5.0])])).collect(), key=repr)
    assert len(flat) == 6 and all((g.whitened is None) == (g.component == 2) for g in flat)
    assert {round(g.whitened, 12) for g in flat if g.component == 1} in ({-1.0, 1.0},) and {g.explained for g in flat} == {0.0, 1.0}
