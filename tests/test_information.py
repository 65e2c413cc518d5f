"""Nearest-neighbour mutual information against brute force over all pairs, with ties, copies, odd rows and many leaves."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tidecast.operators import information as I


def psi(n):
    return np.array([sum(1 / i for i in range(1, int(v))) - I.EULER for v in np.ravel(n)])


def plain(x, y, k=3):
    """All pairs, on the same grid."""
    g = [np.round((v - v.mean()) / v.std() * I.GRID).astype(np.int64) for v in (x, y)]
    dx, dy = (np.abs(v[:, None] - v[None, :]) for v in g)
    both = np.maximum(dx, dy)
    np.fill_diagonal(both, np.iinfo(np.int64).max)
    r = np.sort(both, 1)[:, k - 1]
    near = lambda d: np.where(r == 0, (d == 0).sum(1), (d < r[:, None]).sum(1)) - 1
    n = len(x)
    return max(0.0, (psi([n]) + psi([k]))[0] - psi(near(dx) + 1).mean() - psi(near(dy) + 1).mean())


def cases(n=700):
    rng = np.random.RandomState(4)
    t = rng.randn(n)
    hot = np.where(rng.rand(n) < 0.4, 1.0, rng.randn(n))
    return {"noise": rng.randn(n), "linear": t + 0.3 * rng.randn(n), "square": t * t, "same": t * 2 + 1, "steps": np.round(t), "levels": rng.randint(0, 3, n).astype(float), "hot": hot}, np.where(rng.rand(n) < 0.2, 0.5, t)


@pytest.mark.parametrize("leaf", [40, 1024])
def test_information_equals_all_pairs(spark, monkeypatch, leaf):
    monkeypatch.setattr(I, "LEAF", leaf)
    xs, y = cases()
    names = list(xs) if leaf == 40 else ["linear"]
    rows = [tuple(float(xs[c][i]) for c in names) + (float(y[i]),) for i in range(len(y))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*names, "y"])).repartition(4)
    got = {r["column"]: r.mi for r in I.neighbour_information(df, names, "y").collect()}
    for c in names:
        assert got[c] == pytest.approx(plain(xs[c], y), abs=1e-9), c


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(float(k % 11), float(k % 7)) for k in range(60)]
    df = spark.createDataFrame([*good, (None, 1.0), (1.0, None), (nan, 1.0), (1.0, inf)], "x double, y double")
    r = I.neighbour_information(df, ["x"], "y", k=2).first()
    x, y = np.array(good).T
    assert r.n == 60 and r.mi == pytest.approx(plain(x, y, 2), abs=1e-9)
    constant = spark.createDataFrame([(1.0, float(k)) for k in range(9)], "x double, y double")
    assert [r.mi for r in I.neighbour_information(constant, ["x"], "y").collect()] == [None] == [r.mi for r in I.neighbour_information(df.limit(0), ["x"], "y").collect()]
    assert math.isclose(spark.range(1, 40).select(I.digamma(I.F.col("id")).alias("p")).agg({"p": "sum"}).first()[0], psi(range(1, 40)).sum(), abs_tol=1e-9)


@pytest.mark.parametrize("shape", ["spread", "lines", "clumps"])
def test_a_large_leaf_compares_few_of_its_pairs(monkeypatch, shape):
    """Leaves grow with the table once there are most of them: their work must not grow with the square of their points."""
    rng, n, seen = np.random.RandomState(6), 20_000, [0]
    wide = {"spread": rng.randint(0, 1 << 26, (n, 2)), "lines": np.stack([rng.randint(0, 11, n) << 22, rng.randint(0, 1 << 24, n)], 1), "clumps": np.round(rng.standard_cauchy((n, 2)) * 1000).astype(np.int64)}
    p = np.unique(wide[shape], axis=0)
    own = np.where(rng.rand(len(p)) < 0.1, rng.randint(1, 6, len(p)), 1)

    class Seen(I.Cells):
        def __init__(self, *a):
            super().__init__(*a)
            seen[0] += self.p.shape[0] * self.p.shape[1] ** 2

        def closer(self, p, r, row, *a):
            seen[0] += len(row) * self.p.shape[1]
            return super().closer(p, r, row, *a)

    monkeypatch.setattr(I, "Cells", Seen)
    r = I._home(p, own, 3)[0]
    for i in range(0, len(p), 50):
        d = np.abs(p - p[i]).max(1)
        others = np.sort(np.repeat(d, np.where(d == 0, own - 1, own)))
        assert r[i] == others[2], i
    assert seen[0] < 0.02 * len(p) ** 2
