from fractions import Fraction
from math import floor

import numpy as np
import pytest

from leafloom.llm import whitening as W
from leafloom.session import ship


def moments(*parts):
    out = W.Moments(parts[0].shape[1])
    for x in parts:
        out.add(x)
    return W.Whitening(*W.Moments.of(out.row()))


def test_products_of_limbs_are_exact():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-(2**62), 2**62, (30, 40)), rng.integers(-(2**62), 2**62, (40, 20))
    assert (W.product(a, b) == a.astype(object) @ b.astype(object)).all()
    big = np.array([[1 << 100, -1], [-(1 << 70), 5]], object)
    assert (W.product(big, big) == big @ big).all()
    for edge in (-(1 << 63), (1 << 63) - 1, -32768, 32767, 32768, 0):
        assert sum(int(v[0, 0]) << (16 * k) for k, v in enumerate(W.limbs(np.array([[edge]])))) == edge


def test_states_are_exact_and_merge_in_any_order():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**60), 2**60, (500, 6))
    one, two = W.Moments(6), W.Moments(6)
    one.add(x[:7])
    two.add(x[7:])
    for a, b in ((one, two), (two, one)):
        sums = W.Moments(6)
        sums.merge(*W.Moments.of(a.row()))
        sums.merge(*W.Moments.of(b.row()))
        exact = x.astype(object)
        assert sums.n == 500 and (sums.sums == exact.sum(0)).all() and (sums.products == exact.T @ exact).all()


@pytest.mark.parametrize("scales", [[100.0] * 6, [1e6, 1e4, 50, 20, 3, 2], [1e12, 1e5, 300, 30, 20, 10]])
def test_components_against_numpy(scales):
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    x = np.floor((rng.normal(size=(900, 6)) * scales) @ turn + 1e5).astype(np.int64)
    own = moments(x[:100], x[100:])
    z = own.project(x)
    assert own.count == 4 and abs((z - z.mean(0)).T @ (z - z.mean(0)) / 900 - np.eye(4)).max() < 1e-6
    v = np.cov(x.T.astype(float), bias=True)
    for k in range(4):  # V u = e u, in exact arithmetic
        u = [Fraction(float(c)) for c in own.vectors[:, k]]
        e = float(own.values[k])
        centre = [Fraction(int(s), 900) for s in x.sum(0)]
        y = [sum((int(c) - m) * w for c, m, w in zip(row, centre, u)) for row in x]
        assert abs(float(sum(c * c for c in y) / 900) / e - 1) < 1e-9
    assert np.isclose(float(own.values[0]), np.linalg.eigvalsh(v)[-1], rtol=1e-9)  # the others are beyond float64 here
    exact = 900 * x.astype(object) - x.astype(object).sum(0)
    assert [int(d) for d in own.deviation(x)] == (exact**2).sum(1).tolist()


def brute(rows):
    """All rows of the result by plain fractions and numpy, for vectors of one length."""
    kept = [(k, [max(-(2**63), min(2**63 - 1, floor(Fraction(c) * 256))) for c in v]) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in kept}), object)
    n, s = len(fit), fit.sum(0)
    v = np.array((n * (fit.T @ fit) - np.outer(s, s)) / n**2, float)
    e, u = np.linalg.eigh(v)
    out = {}
    for key, x in kept:
        for c in range(1, 5):
            z = float(((np.array(x, object) - s / n).astype(float) @ u[:, -c]) / np.sqrt(e[-c]))
            out.setdefault((key, c), []).append((n, int(((n * np.array(x, object) - s) ** 2).sum()), z, e[-c] / np.trace(v)))
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(np.float32(c)) for c in rng.normal(size=5) * [3, 2, 1.5, 1, 0.5]]) for k in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(30)] + [(0, rows[0][1]), (201, None), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] * 5), (204, [float("-inf"), 0.0, 0.0, 0.0, 0.0]), (None, rows[3][1])]
    df = ship(spark).createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, x string").repartition(5)
    found = W.whiten(df).collect()
    want = brute(rows)
    signs = {}
    assert len(found) == sum(map(len, want.values()))
    for r in found:
        n, deviation, z, share = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation, r.deviation_text) == (n, deviation, str(deviation))
        assert abs(abs(r.whitened) - abs(z)) < 1e-9 and abs(r.explained / share - 1) < 1e-9 and r.identity_error < 1e-9
        if abs(z) > 1e-6:
            signs.setdefault(r.component, set()).add(r.whitened * z > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_odd_vectors(spark):
    rows = [(1, [1e300, 2.0]), (2, [3.0, 4.0]), (3, [-1e300, 4.0]), (4, []), (5, [1.0]), (6, [2.0]), (7, [7.0, 7.0, 7.0])]
    df = ship(spark).createDataFrame(rows, "vec_id long, embedding array<double>")
    found = W.whiten(df).collect()
    assert sorted((r.vec_id, r.component) for r in found) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (5, 1), (6, 1)]
    far = next(r for r in found if r.vec_id == 1)
    assert far.deviation is None and int(far.deviation_text) > 1 << 63
    assert sorted(r.whitened for r in found if r.dim == 1) == [-1.0, 1.0]
    assert W.whiten(df.limit(0)).count() == 0 and W.whiten(df.where("vec_id = 2")).count() == 0
